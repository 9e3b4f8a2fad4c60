"""Past-only group features (expanding mean/std/max/min/sum, lag, cumcount).

Order inside a group: sequence ascending with NULLs last, then id. The
current row is excluded; no past -> NULL; a NULL group key -> NULL.

A plain ``Window.partitionBy(group)`` sends a whole group through one task,
so a group holding a third of the rows would stall the job. Instead:

1. cut the rows into a bounded number of chunks that are contiguous ranges
   of (group, sequence, id): bounds come from a bounded key sample, so a hot
   group is cut into many chunks, and the chunk id is a pure function of the row;
2. aggregate every (chunk, group) once: row count, value count, shifted
   sums, max, min (a table of about #groups + #chunks rows);
3. carry = exclusive running totals over the chunks of each group (a window
   over that small table; a group has at most #chunks rows there);
4. join the carry back and finish with a window partitioned by
   (chunk, group), which is bounded by the chunk size.

Sums are shifted by a per-group constant (the mean of the group's first
chunk) so the variance does not cancel for large values. For ``lag(n)`` the
carry also holds the group's last values before the chunk, as many as the
longest lag; a row reads its lag inside the chunk's window, or from there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.operators.rank import with_range_chunk
from foldwise.session import materialize

AGGS = ("mean", "std", "max", "min", "sum")


def _all_not_null(keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return cond


def past_features(
    df: DataFrame,
    value: str | None,
    keys: Sequence[str],
    seq: str,
    *,
    id_col: str = "id",
    aggs: Sequence[str] = AGGS,
    lags: Sequence[int] = (),
    cumcount: bool = False,
    n_chunks: int | None = None,
    prefix: str | None = None,
    exact_scale: int | None = None,
) -> DataFrame:
    """Add ``<value>_past_<agg>``, ``<value>_lag<n>`` and ``cumcount`` columns.

    ``exact_scale``: sums for mean/sum are exact DECIMAL(38, scale) sums,
    so results do not depend on partitioning or addition order.
    """
    keys = list(keys)
    if not keys or seq is None:
        raise ValueError("group keys and a sequence column must be set")
    for a in aggs:
        if a not in AGGS:
            raise ValueError(f"unknown aggregate {a!r}; allowed {AGGS}")
    if (aggs or lags) and value is None:
        raise ValueError("a value column is needed for aggregates and lags")
    pre = prefix or (value or "")
    out_cols = [f"{pre}_past_{a}" for a in aggs] + [f"{pre}_lag{L}" for L in lags] + (["cumcount"] if cumcount else [])

    ok = df.where(_all_not_null(keys))
    bad = df.where(~_all_not_null(keys))
    order = [F.col(seq).asc_nulls_last(), F.col(id_col).asc()]
    chunk_key = [*[F.col(k) for k in keys], F.col(seq).isNull(), F.col(seq), F.col(id_col)]
    r = materialize(with_range_chunk(ok, chunk_key, "_chunk", n_chunks))  # read by the totals and the windows

    v = F.col(value).cast("double") if value else F.lit(None).cast("double")
    raw = v.cast(f"decimal(38,{exact_scale})") if exact_scale is not None else v
    zero = F.lit(0).cast(f"decimal(38,{exact_scale})") if exact_scale is not None else F.lit(0.0)
    stats = r.groupBy("_chunk", *keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count(v).alias("_n"),
        F.sum(raw).alias("_raw"),
        F.avg(v).alias("_mu"),
        (F.coalesce(F.var_pop(v), F.lit(0.0)) * F.count(v)).alias("_m2"),
        F.max(v).alias("_mx"),
        F.min(v).alias("_mn"),
    )
    w_first = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stats = stats.withColumn("_K", F.coalesce(F.first("_mu", ignorenulls=True).over(w_first), F.lit(0.0)))
    d = F.coalesce(F.col("_mu"), F.col("_K")) - F.col("_K")
    stats = stats.withColumn("_s1", F.col("_n") * d).withColumn("_s2", F.col("_m2") + F.col("_n") * d * d)
    w_prev = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = stats.select(
        "_chunk", *keys, "_K",
        F.coalesce(F.sum("_rows").over(w_prev), F.lit(0)).alias("_c_rows"),
        F.coalesce(F.sum("_n").over(w_prev), F.lit(0)).alias("_c_n"),
        F.coalesce(F.sum("_raw").over(w_prev), zero).alias("_c_raw"),
        F.coalesce(F.sum("_s1").over(w_prev), F.lit(0.0)).alias("_c_s1"),
        F.coalesce(F.sum("_s2").over(w_prev), F.lit(0.0)).alias("_c_s2"),
        F.max("_mx").over(w_prev).alias("_c_mx"),
        F.min("_mn").over(w_prev).alias("_c_mn"),
    )
    if lags:
        carry = carry.join(_tails(r, keys, seq, id_col, value, max(lags)), ["_chunk", *keys], "left")
    rows = r.join(carry, ["_chunk", *keys], "inner")
    w_in = Window.partitionBy("_chunk", *keys).orderBy(*order)
    w_past = w_in.rowsBetween(Window.unboundedPreceding, -1)
    dv = v - F.col("_K")
    N = F.col("_c_n") + F.count(v).over(w_past)
    S1 = F.col("_c_s1") + F.coalesce(F.sum(dv).over(w_past), F.lit(0.0))
    S2 = F.col("_c_s2") + F.coalesce(F.sum(dv * dv).over(w_past), F.lit(0.0))
    R = F.col("_c_raw") + F.coalesce(F.sum(raw).over(w_past), zero)
    rows = rows.withColumn("_N", N).withColumn("_S1", S1).withColumn("_S2", S2).withColumn("_R", R.cast("double"))
    rows = rows.withColumn("_nth", F.row_number().over(w_in)).withColumn("_pos", F.col("_c_rows") + F.col("_nth") - 1)
    feats = {}
    for L in lags:
        before = F.get("_tail", F.coalesce(F.size("_tail"), F.lit(0)) - L + F.col("_nth") - 1)
        feats[f"{pre}_lag{L}"] = F.when(F.col("_nth") > L, F.lag(value, L).over(w_in)).otherwise(before)
    if "mean" in aggs:
        feats[f"{pre}_past_mean"] = F.when(F.col("_N") > 0, F.col("_R") / F.col("_N"))
    if "std" in aggs:
        var = (F.col("_S2") - F.col("_S1") * F.col("_S1") / F.col("_N")) / (F.col("_N") - 1)
        feats[f"{pre}_past_std"] = F.when(F.col("_N") > 1, F.sqrt(F.greatest(var, F.lit(0.0))))
    if "sum" in aggs:
        feats[f"{pre}_past_sum"] = F.when(F.col("_N") > 0, F.col("_R"))
    if "max" in aggs:
        feats[f"{pre}_past_max"] = F.greatest(F.col("_c_mx"), F.max(v).over(w_past))
    if "min" in aggs:
        feats[f"{pre}_past_min"] = F.least(F.col("_c_mn"), F.min(v).over(w_past))
    if cumcount:
        feats["cumcount"] = F.col("_pos")
    rows = rows.withColumns(feats) if feats else rows
    base_cols = df.columns
    rows = rows.select(*base_cols, *out_cols)
    nulls = bad.select(*base_cols, *[F.lit(None).cast("double" if c != "cumcount" else "long").alias(c) for c in out_cols])
    return rows.unionByName(nulls)


def _tails(r: DataFrame, keys: list[str], seq: str, id_col: str, value: str, longest: int) -> DataFrame:
    """(chunk, group, ``_tail``): the group's last ``longest`` values before the chunk, oldest first.

    Each chunk's last rows are found with a row limit per task before they are shuffled. Any
    ``longest`` earlier chunks of a group hold as many rows, so a window over so many suffices.
    """
    back = Window.partitionBy("_chunk", *keys).orderBy(F.col(seq).desc_nulls_first(), F.col(id_col).desc())
    last = r.select("_chunk", *keys, seq, id_col, F.col(value).alias("_v")).withColumn("_back", F.row_number().over(back))
    last = last.where(F.col("_back") <= longest)
    own = last.groupBy("_chunk", *keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("_back")).alias("b"), F.col("_v").alias("v")))).alias("_own"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(-longest, -1)
    return own.withColumn("_tail", F.transform(F.flatten(F.collect_list("_own").over(earlier)), lambda x: x["v"])).drop("_own")


def fill_past(df: DataFrame, cols: Sequence[str], default: float = 0.0) -> DataFrame:
    """Default fill and float32 cast of past features."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(default)).cast("float") for c in cols})
