"""Embedding near-dedup by collision-counting projections.

Unit vectors x and y of cosine ``c`` are at distance sqrt(2 - 2c), so on a random line
(standard normal coefficients) their projections differ by a normal value of that standard
deviation. Of ``LINES`` sorted projections, a query collides with the vectors in the window
around its own projection; a pair whose count of collisions reaches a bound is verified with
its exact cosine. The bound is calibrated on the binomial law: the highest count that pairs
at the threshold reach with probability ``COUNT_RECALL``.

To spread this over a cluster, every vector lies in ``TABLES`` cells, each the cross product
of ``CELL_LINES`` further projections cut at a random offset into strips that are wide
against the distance sought. Vectors are compared within cells of one label, and a pair only
in the first cell that it shares. Equal vectors are one class with a weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm.common import chunks_of_groups, pairs_of_groups, stash
from foldwise.llm.components import connected

COSINE = 0.98
LINES = 32
WINDOW = 2.0          # half width of a window, in standard deviations of a pair at the threshold
COUNT_RECALL = 0.995
TABLES = 16
CELL_LINES = 16
STRIP = 10.0          # width of a strip, in the same unit
BLOCK = 500           # vectors of a block
TOGETHER = 48         # cells up to this size are sorted together, line by line
SEED = 41


def collision_bound(lines: int = LINES, window: float = WINDOW, recall: float = COUNT_RECALL) -> int:
    """Highest count that a pair at the threshold reaches with probability ``recall``."""
    p = math.erf(window / math.sqrt(2))
    tail = 0.0
    for k in range(lines, -1, -1):
        tail += math.comb(lines, k) * p ** k * (1 - p) ** (lines - k)
        if tail >= recall:
            return k
    return 0


def cell_recall(tables: int = TABLES, lines: int = CELL_LINES, strip: float = STRIP) -> float:
    """Probability that a pair at the threshold shares a cell: a strip separates its
    projections with probability E|difference| / width."""
    same = 1 - math.sqrt(2 / math.pi) / strip
    return 1 - (1 - same ** lines) ** tables


@lru_cache(maxsize=4)
def _directions(dim: int, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim])
    sigma = math.sqrt(2 - 2 * cosine)
    return (rng.normal(size=(dim, LINES)) / sigma, rng.normal(size=(dim, TABLES * CELL_LINES)) / sigma,
            rng.uniform(0, STRIP, TABLES * CELL_LINES))


def _unit(rows: list[list[float] | None], labels: list[int | None]):
    """(row numbers, unit vectors) of the comparable rows, by dimension."""
    by_dim: dict[int, list[int]] = {}
    for i, v in enumerate(rows):
        if v and labels[i] is not None and None not in v:
            by_dim.setdefault(len(v), []).append(i)
    for at in by_dim.values():
        x = np.array([rows[i] for i in at], dtype=np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            norm = np.sqrt((x ** 2).sum(axis=1))
            top = np.abs(x).max(axis=1)
        tiny = (np.isinf(norm) | (norm < 1e-150)) & np.isfinite(top) & (top > 0)
        scaled = x[tiny] / top[tiny, None]  # squares that leave the range of doubles
        x[tiny], norm[tiny] = scaled, np.sqrt((scaled ** 2).sum(axis=1))
        ok = np.isfinite(x).all(axis=1) & (norm > 0)
        yield np.array(at)[ok], x[ok] / norm[ok, None], x[ok]


def _class_ids(at: np.ndarray, raw: np.ndarray, labels: list[int | None]) -> list[int]:
    """Signed 64-bit hash of label and vector (minus zero is zero)."""
    got = [xxhash.xxh3_64_intdigest(labels[i].to_bytes(8, "little", signed=True) + x.tobytes()) for i, x in zip(at, raw + 0.0)]
    return np.array(got, dtype=np.uint64).view(np.int64).tolist()


def _classes(rows: DataFrame) -> DataFrame:
    """(v, c) of every row; c identifies label and vector, null where it links with nothing."""
    schema = T.StructType([rows.schema["v"], T.StructField("c", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(2).to_pylist()
            c: list[int | None] = [None] * batch.num_rows
            for at, _, raw in _unit(batch.column(1).to_pylist(), labels):
                for i, x in zip(at, _class_ids(at, raw, labels)):
                    c[i] = x
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(c, pa.int64())], names=["v", "c"])

    return rows.mapInArrow(run, schema)


def _vectors(rows: DataFrame, cosine: float) -> DataFrame:
    """(c, unit, lines, cells) of every comparable row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(2).to_pylist()
            for at, unit, raw in _unit(batch.column(1).to_pylist(), labels):
                if not len(at):
                    continue
                a, b, shift = _directions(unit.shape[1], cosine)
                strips = np.floor((unit @ b + shift) / STRIP).astype(np.int64).reshape(len(at), TABLES, CELL_LINES)
                cells = [[xxhash.xxh3_64_intdigest(np.array([unit.shape[1], labels[i], t, *s[t]], dtype=np.int64).tobytes())
                          for t in range(TABLES)] for i, s in zip(at, strips)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_class_ids(at, raw, labels), pa.int64()), pa.array(list(unit), pa.list_(pa.float64())),
                     pa.array(list((unit @ a).astype(np.float32)), pa.list_(pa.float32())),
                     pa.array(np.array(cells, dtype=np.uint64).view(np.int64).tolist(), pa.list_(pa.int64()))],
                    names=["c", "unit", "lines", "cells"])

    return rows.mapInArrow(run, "c long, unit array<double>, lines array<float>, cells array<bigint>")


def window_counts(x: np.ndarray, q: np.ndarray, window: float) -> np.ndarray:
    """Collisions of every query (row of ``q``) with every vector (row of ``x``): per line the
    vectors are sorted, and the window around the query adds one to the range inside it."""
    out = np.zeros((len(q), len(x)), dtype=np.int16)
    for k in range(x.shape[1]):
        order = np.argsort(x[:, k], kind="stable")
        line = x[order, k]
        lo = np.searchsorted(line, q[:, k] - window, side="left")
        hi = np.searchsorted(line, q[:, k] + window, side="right")
        step = np.zeros((len(q), len(x) + 1), dtype=np.int8)
        np.add.at(step, (np.arange(len(q)), lo), 1)
        np.add.at(step, (np.arange(len(q)), hi), -1)
        out[:, order] += np.cumsum(step[:, :-1], axis=1, dtype=np.int16)
    return out


def group_counts(x: np.ndarray, size: np.ndarray, window: float) -> np.ndarray:
    """Collisions of all pairs within consecutive groups of rows of ``x``, in the order of
    ``pairs_of_groups``: a line sorts all groups at once, one after the other, and each vector
    collides with those that follow it inside the window."""
    n, start = len(x), np.cumsum(size) - size
    group = np.repeat(np.arange(len(size)), size)
    place = np.arange(n) - start[group]
    pairs = size * (size - 1) // 2
    first = (np.cumsum(pairs) - pairs)[group]
    out = np.zeros(int(pairs.sum()), dtype=np.int16)
    for k in range(x.shape[1]):
        line = x[:, k].astype(np.float64)
        order = np.lexsort((line, group))
        width = line.max() - line.min() + 2 * window + 1.0
        at = group[order] * width + (line[order] - line.min())
        ahead = np.searchsorted(at, at + window, side="right") - np.arange(n) - 1
        a = np.repeat(order, ahead)
        b = order[np.repeat(np.arange(n) + 1 - (np.cumsum(ahead) - ahead), ahead) + np.arange(ahead.sum())]
        lo, hi = np.minimum(place[a], place[b]), np.maximum(place[a], place[b])
        out += np.bincount(first[a] + lo * size[group[a]] - lo * (lo + 1) // 2 + hi - lo - 1, minlength=len(out)).astype(np.int16)
    return out


def _keys(rows: pa.Table) -> np.ndarray:
    return np.stack([rows.column(c).to_numpy().astype(np.int64) for c in ("cell", "i", "j")])


def _starts(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))


class Members:
    """Rows of one or more cells as arrays."""

    def __init__(self, rows: pa.Table):
        def grid(name: str, dtype) -> np.ndarray:
            flat = rows.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
            return flat.reshape(len(rows), -1).astype(dtype, copy=False)

        self.key = _keys(rows)
        self.table, self.block, self.c, self.weight = (rows.column(x).to_numpy().astype(np.int64) for x in ("t", "block", "c", "weight"))
        self.lines, self.cells = grid("lines", np.float32), grid("cells", np.int64)
        self.units = rows.column("unit")  # vectors of one cell have one length, those of different cells may not

    def unit(self, rows: np.ndarray) -> np.ndarray:
        return np.stack(self.units.take(pa.array(rows)).to_numpy())


def _linked_pairs(m: Members, x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """Which of the pairs (x, y), each within one cell and of enough collisions, share no earlier
    cell and reach the cosine."""
    earlier = np.arange(TABLES) < m.table[x][:, None]
    hit = ~((m.cells[x] == m.cells[y]) & earlier).any(axis=1)
    at = np.flatnonzero(hit)
    for k in range(0, len(at), 50_000):
        part = at[k:k + 50_000]
        one = [np.asarray(v) for v in m.units.take(pa.array(x[part])).to_numpy()]
        two = [np.asarray(v) for v in m.units.take(pa.array(y[part])).to_numpy()]
        hit[part] = [float(a @ b) >= cosine for a, b in zip(one, two)]
    return hit


def _large_cell(m: Members, rows: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of one block pair of a large cell, by sorted lines and query-centred windows."""
    i, j, table = m.key[1, rows[0]], m.key[2, rows[0]], m.table[rows[0]]
    x, y = rows[m.block[rows] == i], rows[m.block[rows] == j]
    if not len(x) or not len(y):
        return x[:0], y[:0]
    hit = window_counts(m.lines[x], m.lines[y], WINDOW) >= collision_bound()
    for t in range(table):
        hit &= m.cells[y, t][:, None] != m.cells[x, t][None, :]
    if i == j:
        hit &= np.arange(len(y))[:, None] < np.arange(len(x))[None, :]
    q, p = np.nonzero(hit)
    ux, uy = m.unit(x), m.unit(y)
    ok = np.ones(len(q), dtype=bool)
    for a in range(0, len(q), 200_000):
        part = slice(a, a + 200_000)
        ok[part] = np.einsum("ij,ij->i", uy[q[part]], ux[p[part]]) >= cosine
    return x[p[ok]], y[q[ok]]


def _search(rows: pa.Table, cosine: float) -> Iterator[pa.RecordBatch]:
    """(c, links, root) of the cells in ``rows``; small cells are sorted together, larger ones by blocks."""
    m = Members(rows)
    start = _starts(m.key)
    size = np.diff(np.concatenate([start, [len(rows)]]))
    small = size <= TOGETHER
    for s, n in chunks_of_groups(start[small], size[small], 200_000):
        x, y = pairs_of_groups(s, n)
        rows_of = np.repeat(s - (np.cumsum(n) - n), n) + np.arange(n.sum())
        ok = group_counts(m.lines[rows_of], n, WINDOW) >= collision_bound()
        ok &= (m.key[1, x] == m.key[2, x]) | (m.block[x] != m.block[y])  # two blocks: only pairs between them
        x, y = x[ok], y[ok]
        ok = _linked_pairs(m, x, y, cosine)
        yield from _told(m, x[ok], y[ok])
    for s, n in zip(start[~small], size[~small]):
        yield from _told(m, *_large_cell(m, np.arange(s, s + n), cosine))


def _told(m: Members, x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Per row the weight of its partners and the smallest class that it reaches here."""
    if not len(x):
        return
    rows, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = at[:len(x)], at[len(x):]
    links = np.bincount(a, weights=m.weight[y], minlength=len(rows)) + np.bincount(b, weights=m.weight[x], minlength=len(rows))
    root = m.c[rows]
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if (new == root).all():
            break
        root = new
    yield pa.RecordBatch.from_arrays([pa.array(m.c[rows]), pa.array(links.astype(np.int64)), pa.array(root)],
                                     names=["c", "links", "root"])


def _cell_links(members: DataFrame, vectors: DataFrame, cosine: float) -> DataFrame:
    """(c, links, root): per block pair the weight of the linked classes, and a class of its component."""
    k = members.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("k"))
    k = stash(k.withColumnRenamed("cell", "_cell"), "cell-blocks")
    m = members.join(k, F.col("cell") == F.col("_cell")).drop("_cell")
    m = m.withColumn("block", F.pmod(F.xxhash64("c"), F.col("k")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    m = m.select("cell", "t", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block",
                 F.col("c").alias("_c"))
    m = m.join(vectors, F.col("_c") == F.col("c")).drop("_c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            last = _starts(_keys(rows))[-1] if len(rows) else 0  # the last cell may go on in the next batch
            if last:
                yield from _search(rows.slice(0, last), cosine)
            rest = rows.slice(last)
        if rest is not None and len(rest):
            yield from _search(rest, cosine)

    return m.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(run, "c long, links long, root long")


def near_dedup(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding",
               label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) of every row of ``vectors``.

    Links hold between rows of equal label, not null, and equal dimension whose cosine in
    double precision is at least ``cosine``. A vector that is null, empty or zero, or holds a
    null or non-finite component, or has a null label, links with nothing: it is its own
    component and kept. Repeated rows are vectors of their own and link with each other. Pairs
    are found with the probability of ``cell_recall`` times ``COUNT_RECALL`` at least; classes
    are identified by 64-bit hashes.
    """
    rows = vectors.select(vectors[id_col].alias("v"), vectors[vector_col].cast("array<double>").alias("x"),
                          vectors[label_col].cast("long").alias("label"))
    named = stash(_classes(rows), "vector-class")
    classes = named.where("c is not null").groupBy("c").agg(F.count(F.lit(1)).alias("weight"), F.min("v").alias("low"))
    classes = stash(classes, "classes")
    found = stash(_vectors(rows, cosine).dropDuplicates(["c"]), "vectors")
    cells = found.select("c", F.posexplode("cells").alias("t", "cell"))
    shared = cells.groupBy("cell").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b")
    shared = stash(shared.select(F.col("cell").alias("_cell")), "shared-cells")
    members = stash(cells.join(shared, F.col("cell") == F.col("_cell")).select("cell", "t", "c"), "members")
    # of cells with the same vectors the one of the first table is kept: their pairs belong to it
    h = F.xxhash64("c")
    alike = members.groupBy("cell", "t").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(h).alias("x"),
                                             F.bit_xor(F.xxhash64(h, F.lit(1))).alias("y"))
    one = alike.groupBy("m", "x", "y").agg(F.min(F.struct("t", "cell")).alias("o")).select(F.col("o.cell").alias("_cell"))
    members = stash(members.join(stash(one, "distinct-cells"), F.col("cell") == F.col("_cell")).drop("_cell"), "members")
    weight = classes.select(F.col("c").alias("_w"), "weight")
    weighted = found.join(members.select("c").distinct(), "c", "left_semi").join(weight, F.col("c") == F.col("_w")).drop("_w")
    weighted = stash(weighted, "member-vectors")
    links = stash(_cell_links(members, weighted, cosine), "links")
    total = links.groupBy("c").agg(F.sum("links").alias("links"))
    edges = connected(links.select(F.col("c").alias("a"), F.col("root").alias("b")))
    label = classes.join(total.withColumnRenamed("c", "_l"), F.col("c") == F.col("_l"), "left").join(
        edges.withColumnRenamed("node", "_n"), F.col("c") == F.col("_n"), "left").select(
        "c", "low", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "c").alias("component"))
    label = stash(label, "class-component")
    least = label.groupBy("component").agg(F.min("low").alias("component_id"))
    label = stash(label.join(least, "component").select(F.col("c").alias("_c"), "n_links", "component_id"), "class-name")
    out = named.join(label, F.col("c") == F.col("_c"), "left")
    component = F.when(F.col("c").isNotNull(), F.col("component_id")).otherwise(F.col("v"))
    return out.select(F.col("v").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.col("v").eqNullSafe(component).alias("kept"))
