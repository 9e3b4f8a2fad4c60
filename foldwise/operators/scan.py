"""Ranks and rank statistics by one ordered scan.

Rows are exchanged once, by ranges of (keys, value), and sorted where they land. A task then
reads each key's run of values in order and keeps three segments of it: the first value, the last
one, and all between, which lie in this task alone. The segments of all tasks, at most three per
task and run, are a small table; carried over the tasks' boundaries they say what comes before.

Ties need not share a task: equal (key, value) rows are spread by a hash of the whole row, and
the first and last values of neighbouring tasks are put together in the small table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.operators.rank import BROADCAST_BYTES
from foldwise.session import materialize

FIRST, BETWEEN, LAST = 0, 1, 2


def by_range(df: DataFrame, keys: Sequence[str], value: str, spread_by: Sequence[str] = ()) -> DataFrame:
    """``df`` in one global order of (keys, value): ranges over the tasks, sorted within each. Ties
    are spread by the hash of ``spread_by``, or of all columns."""
    spread = df.withColumn("_spread", F.xxhash64(*[F.col(c) for c in (spread_by or df.columns)]))
    return spread.repartitionByRange(*keys, value, "_spread").drop("_spread").sortWithinPartitions(*keys, value)


def _run_starts(columns: Sequence[pa.Array], n: int) -> np.ndarray:
    """Rows at which any of the columns differs from the row before (nulls are equal)."""
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for c in columns:
        a, b = c.slice(1), c.slice(0, n - 1)
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        new[1:] |= differ | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return np.flatnonzero(new)


def _number(value: str):
    """The value as a double; NaN counts as the largest."""
    return F.nanvl(F.col(value).cast("double"), F.lit(float("inf")))


class _Run:
    """One key's values in a task, as far as read: the first one, the last one, sums between.

    ``pairs`` adds up, over the values between, weight 0 x (weight 1 before + half of its own)."""

    def __init__(self, key: pa.RecordBatch):
        self.key, self.first, self.last = key, None, None
        self.between, self.pairs = np.zeros(2), 0.0

    def add(self, values: np.ndarray, weights: np.ndarray) -> None:
        """Distinct ascending values, none below the last one."""
        if self.first is None:
            self.first, values, weights = (values[0], weights[0]), values[1:], weights[1:]
        elif self.last is None:
            if values[0] == self.first[0]:
                self.first, values, weights = (values[0], self.first[1] + weights[0]), values[1:], weights[1:]
        elif values[0] == self.last[0]:
            weights = weights.copy()
            weights[0] += self.last[1]
        else:
            values = np.concatenate([[self.last[0]], values])
            weights = np.concatenate([[self.last[1]], weights])
        if not len(values):
            return
        done = weights[:-1]
        before = self.between[1] + np.cumsum(done[:, 1]) - done[:, 1]
        self.pairs += float((done[:, 0] * (before + done[:, 1] / 2.0)).sum())
        self.between = self.between + done.sum(axis=0)
        self.last = (values[-1], weights[-1])

    def segments(self):
        yield FIRST, self.first[0], self.first[1], 0.0
        if self.between.any():
            yield BETWEEN, 0.0, self.between, self.pairs
        if self.last is not None:
            yield LAST, self.last[0], self.last[1], 0.0


def segments(ordered: DataFrame, keys: Sequence[str], value: str, weights: Sequence[str]) -> DataFrame:
    """(keys, task, part, value, w0, w1, pairs) of the runs in every task of a ``by_range`` table.

    ``weights`` are two numeric columns. A null value stands before all others.
    """
    K = list(keys)
    rows = ordered.select(*K, _number(value).alias("_value"), *[F.col(w).cast("double") for w in weights])
    schema = T.StructType([*[T.StructField(k, rows.schema[k].dataType) for k in K], T.StructField("task", T.IntegerType()),
                           T.StructField("part", T.IntegerType()), T.StructField("value", T.DoubleType()),
                           *[T.StructField(c, T.DoubleType()) for c in ("w0", "w1", "pairs")]])

    def told(runs: list[_Run]) -> Iterator[pa.RecordBatch]:
        if not runs:
            return
        task = TaskContext.get().partitionId()
        rows = [(i, *s) for i, r in enumerate(runs) for s in r.segments()]
        at = pa.array([r[0] for r in rows])
        named = pa.Table.from_batches([r.key for r in runs]) if K else None
        keyed = [named.column(k).combine_chunks().take(at) for k in K]
        yield pa.RecordBatch.from_arrays(
            [*keyed, pa.array([task] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
             pa.array([float(r[2]) for r in rows]), *[pa.array([float(r[3][j]) for r in rows]) for j in (0, 1)],
             pa.array([r[4] for r in rows])], schema=pa.schema([*[(k, keyed[i].type) for i, k in enumerate(K)], ("task", pa.int32()),
             ("part", pa.int32()), ("value", pa.float64()), ("w0", pa.float64()), ("w1", pa.float64()), ("pairs", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            value = pc.fill_null(batch.column(len(K)), -np.inf)
            starts = np.concatenate([_run_starts([*batch.columns[:len(K)], value], n), [n]])
            new_key = np.isin(starts[:-1], _run_starts(batch.columns[:len(K)], n)) if K else starts[:-1] == 0
            v = value.to_numpy(zero_copy_only=False)[starts[:-1]]
            w = np.stack([np.add.reduceat(batch.column(len(K) + 1 + j).to_numpy(zero_copy_only=False), starts[:-1]) for j in (0, 1)], axis=1)
            edges = np.concatenate([np.flatnonzero(new_key), [len(v)]])
            done = []
            for a, b in zip(edges[:-1], edges[1:]):
                key = batch.select(K).slice(starts[a], 1) if K else None
                same = now is not None and (not K or _same(now.key, key))
                if not same:
                    done += [now] if now is not None else []
                    now = _Run(key)
                now.add(v[a:b], w[a:b])
            yield from told(done)
        if now is not None:
            yield from told([now])

    return rows.mapInArrow(run, schema)


def _same(a: pa.RecordBatch, b: pa.RecordBatch) -> bool:
    return all(x.equals(y) for x, y in zip(a.columns, b.columns))


def carried(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``segments`` with what lies before each: values that end one task and begin the next are put
    together; adds all of the value's weights (``all0``, ``all1``) and those before (``before0``, ``before1``).

    The windows see at most three rows per task and run.
    """
    K = list(keys)
    edge = F.col("part") != BETWEEN
    # a row per value at an edge, and one per stretch between edges
    name = F.when(edge, F.struct(F.lit(-1).alias("task"), F.col("value").alias("value"))).otherwise(
        F.struct(F.col("task").alias("task"), F.lit(0.0).alias("value")))
    named = found.withColumns({"_name": name, "_at": F.col("task").cast("long") * 3 + F.col("part")})
    whole = Window.partitionBy(*K, "_name")
    named = named.withColumns({"all0": F.sum("w0").over(whole), "all1": F.sum("w1").over(whole), "_from": F.min("_at").over(whole)})
    head = F.col("_at") == F.col("_from")
    before = Window.partitionBy(*K).orderBy("_from", "_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a value's total counts where it begins; every row of the value then takes off its own total
    named = named.withColumns({f"before{j}": F.sum(F.when(head, F.col(f"all{j}")).otherwise(0.0)).over(before) - F.col(f"all{j}") for j in (0, 1)})
    return named.withColumn("head", head).drop("_name", "_at", "_from")


def pair_statistic(df: DataFrame, keys: Sequence[str], value: str, low: str, high: str, spread_by: Sequence[str] = ()) -> DataFrame:
    """(keys, pairs, n_low, n_high): over all pairs of a ``high`` and a ``low`` row of a key, how often
    the high one has the larger value, ties as a half. ``low`` and ``high`` are 0/1 or count columns."""
    K = list(keys)
    rows = df.select(*dict.fromkeys([*K, value, low, high, *spread_by]))
    found = segments(by_range(rows, K, value, spread_by), K, value, [high, low])
    c = carried(found, K)
    own = F.when(F.col("part") == BETWEEN, F.col("pairs") + F.col("w0") * F.col("before1")).otherwise(
        F.when(F.col("head"), F.col("all0") * (F.col("before1") + F.col("all1") / 2.0)).otherwise(0.0))
    return c.groupBy(*K).agg(F.sum(own).alias("pairs"), F.sum("w1").alias("n_low"), F.sum("w0").alias("n_high"))


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str = "rank") -> DataFrame:
    """``df`` with the 1-based rank of ``value`` within its keys; ties share their mean rank.

    The rows are exchanged once and written in order; a second scan of them gives each row its
    place, with the few numbers of its task and run joined to it.
    """
    K, cols = list(keys), df.columns
    ordered = materialize(by_range(df, K, value).withColumn("_task", F.spark_partition_id()))
    ones = ordered.withColumns({"_one": F.lit(1.0), "_zero": F.lit(0.0)})
    c = materialize(carried(segments(ones, K, value, ["_one", "_zero"]), K))
    rank = F.when(F.col("part") == BETWEEN, F.col("before0")).otherwise(F.col("before0") + (F.col("all0") + 1) / 2.0)

    def of(part: int, col):
        return F.max(F.when(F.col("part") == part, col))

    places = c.groupBy(*K, F.col("task").alias("_task")).agg(
        of(FIRST, F.col("value")).alias("_first"), of(FIRST, rank).alias("_first_rank"), of(BETWEEN, rank).alias("_between"),
        of(LAST, F.col("value")).alias("_last"), of(LAST, rank).alias("_last_rank"))
    places = places.withColumnsRenamed({k: f"_k_{k}" for k in [*K, "_task"]})
    cond = [ordered[k].eqNullSafe(places[f"_k_{k}"]) for k in K] + [ordered["_task"] == places["_k__task"]]
    if c.count() * (64 + 32 * len(K)) <= BROADCAST_BYTES:
        rows = ordered.join(F.broadcast(places), cond)
    else:  # runs move once more, whole; their order is made anew
        rows = ordered.join(places, cond).sortWithinPartitions("_task", *K, value)
    extra = ["_first", "_first_rank", "_between", "_last", "_last_rank"]
    rows = rows.select(*cols, "_task", _number(value).alias("_value"), *extra)
    schema = T.StructType([*[df.schema[c] for c in cols], T.StructField(out, T.DoubleType())])
    at_keys = [cols.index(k) for k in K]
    n_cols = len(cols)

    def ranked(batch: pa.RecordBatch, ranks: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns[:n_cols], pa.array(ranks)], names=[*cols, out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tie = [], None     # rows of a tie between the edges that may go on, and its value
        key, read = None, 0      # the current run, and its rows between the edges that are done

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, read
            n = sum(b.num_rows for b in held)
            for b in held:
                yield ranked(b, np.full(b.num_rows, b.column(n_cols + 4)[0].as_py() + read + (n + 1) / 2.0))
            held, read = [], read + n

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            value = pc.fill_null(batch.column(n_cols + 1), -np.inf).to_numpy(zero_copy_only=False)
            first, last = (pc.fill_null(batch.column(n_cols + 2 + j), np.nan).to_numpy(zero_copy_only=False) for j in (0, 3))
            named = [batch.column(i) for i in [*at_keys, n_cols]]
            runs = np.concatenate([_run_starts(named, n), [n]])
            for a, b in zip(runs[:-1], runs[1:]):
                own = [c.slice(a, 1) for c in named]
                if key is None or not all(x.equals(y) for x, y in zip(key, own)):
                    key, read = own, 0
                v = value[a:b]
                lo, hi = int((v == first[a]).sum()), (b - a) - int((v == last[a]).sum())
                if lo:
                    part = batch.slice(a, lo)
                    yield ranked(part, np.full(lo, part.column(n_cols + 3)[0].as_py()))
                if hi > lo:
                    inner = v[lo:hi]
                    ties = np.concatenate([[0], np.flatnonzero(inner[1:] != inner[:-1]) + 1, [len(inner)]])
                    if held and tie == inner[0]:  # the tie goes on
                        held.append(batch.slice(a + lo, ties[1]))
                        ties = ties[1:]
                    if len(ties) > 1:
                        yield from flush()
                        sizes, whole = np.diff(ties), ties[-2]
                        if whole > ties[0]:
                            part = batch.slice(a + lo + ties[0], whole - ties[0])
                            base = part.column(n_cols + 4)[0].as_py() + read
                            yield ranked(part, np.repeat(base + (ties[:-2] - ties[0]) + (sizes[:-1] + 1) / 2.0, sizes[:-1]))
                            read += int(whole - ties[0])
                        held, tie = [batch.slice(a + lo + whole, ties[-1] - whole)], inner[whole]
                if hi < b - a:
                    yield from flush()
                    part = batch.slice(a + hi, b - a - hi)
                    yield ranked(part, np.full(b - a - hi, part.column(n_cols + 6)[0].as_py()))

    return rows.mapInArrow(run, schema)
