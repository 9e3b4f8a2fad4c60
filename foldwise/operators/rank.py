"""Global ranks and running sums without a single-task window.

A window with no partition key (or with a key that holds a third of the
rows) moves that whole set through one task. Instead every operator here
splits the ordered set into *buckets* that are consistent with the order
(a hash prefix, or approximate quantile edges of a value), computes
per-bucket totals (a table of bounded size per partition), turns
them into offsets, level by level of the bucket columns, with windows over
that small table, and finishes with a window partitioned by (key, bucket).
The result equals the global window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.session import materialize, with_scalars

# An explicit broadcast hint is given only to a table whose measured size is below this.
BROADCAST_BYTES = 32 << 20
MAX_BUCKETS = 4096
MAX_CHUNKS = 4096
SALTS = 64


def default_buckets(spark, per_partition: int = 8, lo: int = 64, hi: int = MAX_BUCKETS) -> int:
    """Power-of-two bucket count scaled with the configured shuffle parallelism, bounded.

    Buckets are the units of parallel work of the second-level windows, so
    a cluster configured for more shuffle partitions gets more (smaller)
    buckets, up to ``hi``: the per-bucket tables have a fixed largest size.
    """
    sp = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = lo
    while n < min(hi, sp * per_partition):
        n *= 2
    return n


def default_hex_digits(spark) -> int:
    """Hex digits of a hash prefix giving about 32 buckets per shuffle partition, 65,536 at most."""
    target = 32 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = 2
    while 16 ** d < target and d < 4:
        d += 1
    return d


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def _offsets(totals: DataFrame, weights: Sequence[str], bucket: Sequence[str], partition_by: Sequence[str]) -> DataFrame:
    """(partition, bucket, ``_off_<w>``): what comes before each bucket, level by level.

    The bucket columns are the levels of a tree: a window orders the children of one node only, so
    it sees the classes of a partition, or the hash prefixes of a class, never their product.
    """
    P, B = list(partition_by), list(bucket)
    names = {w: [f"_off{i}_{w}" for i in range(len(B))] for w in weights}
    out = totals
    for i in range(len(B) - 1, -1, -1):
        path = P + B[:i + 1]
        level = totals if i == len(B) - 1 else totals.groupBy(*path).agg(*[F.sum(w).alias(w) for w in weights])
        before = Window.partitionBy(*P, *B[:i]).orderBy(F.col(B[i]).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
        level = level.select(*path, *[F.coalesce(F.sum(w).over(before), F.lit(0)).alias(names[w][i]) for w in weights])
        out = level if i == len(B) - 1 else _join_null_safe(out, level, path)
    return out.select(*P, *B, *[sum((F.col(c) for c in names[w]), F.lit(0)).alias(f"_off_{w}") for w in weights])


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which null keys meet; the keys stay once."""
    if not keys:
        return with_scalars(left, right)
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = [left[k].eqNullSafe(right[f"_r_{k}"]) for k in keys]
    return left.join(right, cond, "inner").drop(*[f"_r_{k}" for k in keys])


def global_row_number(
    df: DataFrame,
    bucket: Sequence[str],
    order: Sequence,
    partition_by: Sequence[str] = (),
    out: str = "rn",
) -> DataFrame:
    """``row_number() over (partition by P order by bucket..., order...)``.

    ``bucket`` are existing columns (ascending) that coarsen the order, e.g. a class and then a
    hash prefix of the hash in ``order``; each level must have a bounded number of values
    within the one above, as their offsets are one window per node.
    """
    P, B = list(partition_by), list(bucket)
    # distribute on (partition, bucket) first: order expressions (e.g. a hash) are then
    # evaluated after the exchange instead of being shuffled with every row
    w_in = Window.partitionBy(*P, *B).orderBy(*_cols(order))
    placed = materialize(df.repartition(*[F.col(c) for c in P + B]).withColumn("_in_bucket", F.row_number().over(w_in)))
    # ``df`` is read once: the buckets are counted, and their offsets joined, on the written rows
    counts = placed.groupBy(*P, *B).agg(F.max("_in_bucket").alias("_bucket_n"))
    offsets = materialize(_offsets(counts, ["_bucket_n"], B, P))
    if offsets.count() * 16 * (2 + len(P) + len(B)) <= BROADCAST_BYTES:
        offsets = F.broadcast(offsets)
    joined = _join_null_safe(placed, offsets, P + B)
    return joined.withColumn(out, (F.col("_in_bucket") + F.col("_off__bucket_n")).cast("long")).drop("_in_bucket", "_off__bucket_n")


def prefix_sums(
    df: DataFrame,
    weights: Sequence[str],
    bucket: Sequence[str],
    order: Sequence,
    partition_by: Sequence[str] = (),
    prefix: str = "before_",
) -> DataFrame:
    """Exclusive running sums of ``weights`` in (partition, bucket, order) order.

    Rows must be unique in their order within a partition (aggregate ties
    first); each row gets ``before_<w>`` = sum of w over all earlier rows.
    """
    P, B = list(partition_by), list(bucket)
    totals = df.groupBy(*P, *B).agg(*[F.sum(w).alias(f"_t_{w}") for w in weights])
    out = _join_null_safe(df, _offsets(totals, [f"_t_{w}" for w in weights], B, P), P + B)
    w_in = Window.partitionBy(*P, *B).orderBy(*_cols(order)).rowsBetween(Window.unboundedPreceding, -1)
    for w in weights:
        out = out.withColumn(f"{prefix}{w}", F.coalesce(F.sum(w).over(w_in), F.lit(0)) + F.col(f"_off__t_{w}"))
    return out.drop(*[f"_off__t_{w}" for w in weights])


def quantile_bucket(
    df: DataFrame,
    value: str,
    partition_by: Sequence[str] = (),
    n_buckets: int | None = None,
    out: str = "_qb",
    accuracy: int = 10000,
) -> DataFrame:
    """Bucket id that is non-decreasing in ``value`` within each partition.

    Edges are approximate quantiles of ``value`` per partition; the bucket is
    the number of edges strictly below the value, found by binary search
    (log2(n_buckets) steps, JVM-side). Equal values share a bucket, so the
    bucket is a valid coarsening of the value order; approximate edges only
    affect bucket balance, never correctness.
    """
    n_buckets = n_buckets or default_buckets(df.sparkSession)
    if n_buckets & (n_buckets - 1):
        raise ValueError("n_buckets must be a power of two")
    P = list(partition_by)
    pct = F.array(*[F.lit(i / n_buckets) for i in range(1, n_buckets)])
    edges = df.groupBy(*P).agg(F.percentile_approx(F.col(value), pct, accuracy).alias("_edges"))
    steps = []
    s = n_buckets // 2
    while s >= 1:
        steps.append(s)
        s //= 2
    if P:
        # every row reads the edges of its partition: broadcast them while they are measured to be
        # small; else spread the few hot partition keys with a salt on both sides
        edges = materialize(edges)
        if edges.count() * n_buckets * 8 <= BROADCAST_BYTES:
            joined = df.join(F.broadcast(edges), on=P, how="inner")
        else:
            salted = edges.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            joined = df.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(SALTS)).cast("int")).join(
                salted, on=[*P, "_salt"], how="inner").drop("_salt")
    else:
        joined = with_scalars(df, edges)
    v = F.col(value)
    search = F.aggregate(
        F.array(*[F.lit(x) for x in steps]),
        F.lit(0),
        lambda pos, st: F.when(F.element_at(F.col("_edges"), pos + st) < v, pos + st).otherwise(pos),
    )
    return joined.withColumn(out, search).drop("_edges")


def with_range_chunk(
    df: DataFrame,
    key: Sequence[Column],
    out: str = "_chunk",
    n_chunks: int | None = None,
    oversample: int = 20,
    seed: int = 17,
) -> DataFrame:
    """``df`` with a chunk id that is non-decreasing in the composite ``key``.

    Bounds come from a random sample of about n_chunks * oversample keys, and n_chunks is at
    most ``MAX_CHUNKS`` whatever the number of partitions, so what reaches the driver is
    bounded. A key range that holds many rows is cut into many chunks. The bounds are one row
    of a table, and the id is a pure function of the row: every branch of a plan that
    recomputes it gets the same chunk.
    """
    n_chunks = min(MAX_CHUNKS, n_chunks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kstruct = F.struct(*[k.alias(f"c{i}") for i, k in enumerate(key)])
    keys = df.select(kstruct.alias("k"))
    n_rows = df.count()
    if n_rows == 0 or n_chunks <= 1:
        return df.withColumn(out, F.lit(0))
    sample = keys.sample(False, min(1.0, n_chunks * oversample / n_rows), seed).collect()
    found = sorted((tuple(r["k"]) for r in sample), key=_sort_key)
    bounds = []
    for i in range(1, n_chunks):
        if found:
            b = found[min(len(found) - 1, (i * len(found)) // n_chunks)]
            if not bounds or _sort_key(b) > _sort_key(bounds[-1]):
                bounds.append(b)
    if not bounds:
        return df.withColumn(out, F.lit(0))
    schema = T.StructType([T.StructField("_bounds", T.ArrayType(keys.schema["k"].dataType))])
    row = df.sparkSession.createDataFrame([(bounds,)], schema)
    size = len(bounds)
    steps = [1 << i for i in range(size.bit_length(), -1, -1)]
    # number of bounds <= key, by binary search
    at = F.aggregate(
        F.array(*[F.lit(x) for x in steps]), F.lit(0),
        lambda pos, st: F.when((pos + st <= size) & (F.get(F.col("_bounds"), pos + st - 1) <= kstruct), pos + st).otherwise(pos))
    return with_scalars(df, row).withColumn(out, at).drop("_bounds")


def _sort_key(t):
    # Spark struct order: NULL first, then values ascending
    return tuple((v is not None, v) for v in t)
