"""Member prediction tables side by side: matrix, alignment check, correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.session import with_scalars


def member_matrix(long: DataFrame, members: Sequence[str], id_col: str = "id", member_col: str = "member",
                  p: str = "p") -> DataFrame:
    """(id, <member>...): one group-by over the union (one shuffle, not M joins).

    Column order is the member order; multiclass blocks come from array
    columns, so their class order is the label-map order.
    """
    return long.groupBy(id_col).agg(*[F.first(F.when(F.col(member_col) == m, F.col(p)), ignorenulls=True).alias(m) for m in members])


def alignment_report(long: DataFrame, reference_ids: DataFrame, members: Sequence[str], id_col: str = "id",
                     member_col: str = "member") -> DataFrame:
    """(member, n_rows, n_dup_ids, n_missing, n_extra) against the reference id set.

    Set equality on keys: a permuted but complete table is aligned.
    """
    spark = long.sparkSession
    mlist = spark.createDataFrame([(m,) for m in members], f"{member_col} string")
    per_id = long.groupBy(member_col, id_col).agg(F.count(F.lit(1)).alias("_c"))
    dup = per_id.groupBy(member_col).agg(
        F.sum("_c").alias("n_rows"), F.count_if(F.col("_c") > 1).alias("n_dup_ids"))
    ref = reference_ids.select(id_col).distinct()
    n_ref = ref.agg(F.count(F.lit(1)).alias("_n_ref"))  # one row
    # ids of each member found in the reference (semi join): missing = |ref| - found
    found = per_id.join(ref, id_col, "left_semi").groupBy(member_col).agg(F.count(F.lit(1)).alias("_found"))
    extra = per_id.join(ref, id_col, "left_anti").groupBy(member_col).agg(F.count(F.lit(1)).alias("n_extra"))
    out = with_scalars(mlist.join(dup, member_col, "left").join(found, member_col, "left")
                       .join(extra, member_col, "left"), n_ref)
    out = out.withColumn("n_missing", F.col("_n_ref") - F.coalesce(F.col("_found"), F.lit(0)))
    return out.select(member_col, *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
                                    for c in ("n_rows", "n_dup_ids", "n_missing", "n_extra")])


def check_alignment(report: DataFrame) -> None:
    """Fail with every misaligned member listed."""
    bad = report.where("n_dup_ids > 0 OR n_missing > 0 OR n_extra > 0").collect()  # at most M rows
    if bad:
        raise ValueError("member tables are not aligned with the reference ids: " +
                         "; ".join(f"{r[0]}: dup={r['n_dup_ids']} missing={r['n_missing']} extra={r['n_extra']}" for r in bad))


def correlation(matrix: DataFrame, members: Sequence[str], digits: int = 4) -> DataFrame:
    """Pearson correlation of every member pair in one aggregate (long form).

    covar_pop / (stddev_pop * stddev_pop) with try_divide: a constant member
    gives NULL instead of a division error.
    """
    ms = list(members)
    aggs = [F.stddev_pop(m).alias(f"_sd_{i}") for i, m in enumerate(ms)]
    for i, a in enumerate(ms):
        for j, b in enumerate(ms):
            if j > i:
                aggs.append(F.covar_pop(a, b).alias(f"_cv_{i}_{j}"))
    row = matrix.agg(*aggs)
    cells = []
    for i, a in enumerate(ms):
        for j, b in enumerate(ms):
            if i == j:
                v = F.when(F.col(f"_sd_{i}") > 0, F.lit(1.0))
            else:
                lo, hi = min(i, j), max(i, j)
                den = F.col(f"_sd_{i}") * F.col(f"_sd_{j}")
                v = F.when(den > 0, F.col(f"_cv_{lo}_{hi}") / den)
            cells.append(F.struct(F.lit(a).alias("member_a"), F.lit(b).alias("member_b"), F.round(v, digits).alias("corr")))
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
