"""Exploration aggregates: target rate by category, class histograms, column profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.session import with_scalars


def cat_target_rate(df: DataFrame, col: str, y: str = "y") -> DataFrame:
    """Target mean and count per observed category, plus the overall mean."""
    overall = df.agg(F.avg(F.col(y).cast("double")).alias("overall"))  # one row
    per = df.where(F.col(col).isNotNull()).groupBy(col).agg(
        F.avg(F.col(y).cast("double")).alias("rate"), F.count(F.lit(1)).alias("n")
    )
    return with_scalars(per, overall)


def num_hist_by_class(df: DataFrame, x: str, y: str = "y", bins: int = 50) -> DataFrame:
    """Histogram of ``x`` per class on common edges, density normalised within class.

    Edges are ``lo + i * (hi - lo) / bins`` of the global min/max; the last
    bin is closed on the right. Returns (class, bin, lo, count, density).
    """
    rng = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))  # one row
    d = with_scalars(df.where(F.col(x).isNotNull()), rng)
    width = (F.col("_hi") - F.col("_lo")) / bins
    pos = F.floor((F.col(x) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(F.least(pos, F.lit(bins - 1))).cast("int")
    d = d.withColumn("bin", b).withColumn("_w", F.when(F.col("_hi") == F.col("_lo"), F.lit(1.0)).otherwise(width))
    cnt = d.groupBy(y, "bin", "_lo", "_w").agg(F.count(F.lit(1)).alias("count"))
    cls = df.where(F.col(x).isNotNull()).groupBy(y).agg(F.count(F.lit(1)).alias("_cn"))
    out = cnt.join(cls, y)
    return out.select(
        y, "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("lo"), "count",
        (F.col("count") / (F.col("_cn") * F.col("_w"))).alias("density"),
    )


def profile(df: DataFrame, id_col: str = "id", columns: Sequence[str] | None = None,
            approx: bool = False) -> DataFrame:
    """One row per column: type, null count, distinct count (nulls excluded),
    first and second value in id order. One aggregate pass + a top-2 by id."""
    cols = list(columns or df.columns)
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}__null") for c in cols],
                    *[F.approx_count_distinct(c).alias(f"{c}__distinct") for c in cols if approx])
    if approx:
        stats = counts
    else:  # distinct (column, value) pairs once, instead of every row once per column
        pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(cols)])
        pairs = df.select(F.explode(pairs).alias("p")).where(F.col("p.v").isNotNull()).select("p.*").distinct()
        per = pairs.groupBy("i").agg(F.count(F.lit(1)).alias("n"))
        wide = per.agg(*[F.coalesce(F.max(F.when(F.col("i") == i, F.col("n"))), F.lit(0)).alias(f"{c}__distinct")
                         for i, c in enumerate(cols)])
        stats = with_scalars(counts, wide)
    first2 = df.select(id_col, *[F.col(c).cast("string").alias(f"{c}__v") for c in cols]).orderBy(id_col).limit(2)
    firsts = first2.agg(
        *[F.min_by(f"{c}__v", id_col).alias(f"{c}__first") for c in cols],
        *[F.max_by(f"{c}__v", id_col).alias(f"{c}__last2") for c in cols],
        F.count(F.lit(1)).alias("_k"),
    )
    wide = with_scalars(stats, firsts)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = [
        F.struct(
            F.lit(c).alias("feature"), F.lit(types[c]).alias("dtype"),
            F.col(f"{c}__null").cast("long").alias("n_null"), F.col(f"{c}__distinct").cast("long").alias("n_distinct"),
            F.col(f"{c}__first").alias("first_value"),
            F.when(F.col("_k") > 1, F.col(f"{c}__last2")).alias("second_value"),
        )
        for c in cols
    ]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
