"""N-gram Jaccard join over count vectors in an R-tree.

Two texts link when the Jaccard similarity of their sets of word shingles reaches a
threshold t. Texts with equal sets are one class; the join runs between classes.

Tokens are hashed into groups and a set becomes the vector of its group counts. The overlap
of two sets is at most the sum of the coordinate-wise minima of their vectors, and that
bound also holds against the upper corner of a node that holds many vectors, so an R-tree
over the vectors lists the partners of a set without reading the others. Pairs that pass the
bound are verified on the sets themselves.

To spread the tree over a cluster its vectors are first dealt by groups with equal content.
Two sets with J >= t differ in at most D = (|A| + |B|)(1 - t)/(1 + t) tokens, hence in at
most D groups. With the non-empty groups of each set in one global order (largest first,
then by hash), the first D + 1 of both must share a group of equal content. So each set
joins only the partitions of its first D + 1 groups, and no linked pair is lost. Groups per
set follow from its size band; sets just above a band's edge also join the band below.

Within the partitions, classes are first tied to one member each (a star): to the one that meets
most others in its partitions, which in a group of near copies is their common original. This
settles such groups without listing their pairs. Only where different components remain in a
partition are all pairs between them searched in R-trees, over blocks of bounded size. In
partitions of many members, where pairs just below the threshold would leave by the million,
half of every token's hash goes along and the overlap is counted on these before a pair leaves.
All pairs that leave are verified on the sets.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm.common import discard, stash, unused
from foldwise.llm.components import connected
from foldwise.llm.words import Words, mix, run_hash, text_ranges

DIMS = (64, 64, 64, 256, 1024, 4096)  # groups of the count vectors, by size band; the last for all above
LEAF = 16          # vectors of a leaf, and nodes of an inner node
BLOCK = 500        # vectors of a block
ELEMENTS = 4_000_000  # coordinates compared at a time
TOGETHER = 256     # groups up to this size share a forest of trees of one or two levels
SLAB = 4096        # tokens of a matrix product
MANY = 128         # members of a partition above which the overlap is counted before a pair leaves
STARS = 3          # rounds of stars before the search for all pairs
SMALL = 16         # sets below this size use each token as a group

_GROUP, _ONE, _TWO = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


# ------------------------------------------------------------ sets
class ShingleSets:
    """Distinct word shingles of a batch of texts: ``token`` ascending within each ``row``."""

    def __init__(self, texts: Sequence[str | None], n: int):
        w = Words(texts)
        count = w.counts()
        full = len(w.hash) - n + 1
        rows, tokens = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
        if full > 0:
            at = np.flatnonzero(w.row[:full] == w.row[n - 1:])
            h = np.zeros(len(at), dtype=np.uint64)
            for k in range(n):
                h = mix(h * np.uint64(7) + w.hash[at + k])
            rows.append(w.row[at])
            tokens.append(h)
        few = (count > 0) & (count < n)  # the whole sequence is one shingle
        if few.any():
            own = few[w.row]
            lens = count[few]
            rows.append(np.flatnonzero(few))
            tokens.append(run_hash(w.hash[own], np.cumsum(lens) - lens, lens) ^ _TWO)
        row, token = np.concatenate(rows), np.concatenate(tokens)
        order = np.lexsort((token, row))
        row, token = row[order], token[order]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (token[1:] != token[:-1])
        self.row, self.token = row[new], token[new]
        self.size = np.bincount(self.row, minlength=len(texts))
        self.start = np.cumsum(self.size) - self.size

    def ids(self) -> np.ndarray:
        """64-bit hash of each row's set; equal for equal sets."""
        out = np.zeros(len(self.size), dtype=np.uint64)
        has = self.size > 0
        if has.any():
            at = self.start[has]
            one = np.add.reduceat(mix(self.token ^ _ONE), at)
            two = np.add.reduceat(mix(self.token ^ _TWO), at)
            out[has] = mix(one ^ mix(two + self.size[has].astype(np.uint64)))
        return out

    def counts(self) -> list[bytes]:
        """Tokens of each row per group, as 16-bit numbers. The numbers of groups are powers of two
        and a vector folds to fewer groups by adding its parts, so any two can be compared."""
        group = (mix(self.token ^ _GROUP) >> np.uint64(40)).astype(np.int64)
        dims = np.array(DIMS)[np.minimum(_band(self.size), len(DIMS) - 1)]
        out = []
        for a, n, d in zip(self.start, self.size, dims):
            out.append(np.minimum(np.bincount(group[a:a + n] % d, minlength=d), 65535).astype("<u2").tobytes())
        return out


def _differ(a, b, num: int, den: int):
    """Most tokens in which sets of sizes a and b differ when they link."""
    return (a + b) * (den - num) // (den + num)


def _band(n: np.ndarray) -> np.ndarray:
    """0 below 4, 1 below 16, 2 below 64, ..."""
    out = np.zeros(len(n), dtype=np.int64)
    edge = 4
    while (n >= edge).any():
        out += n >= edge
        edge *= 4
    return out


def partitions(s: ShingleSets, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, partition): the first D + 1 groups of every set, in its band and the band below."""
    n = s.size
    band = _band(n)
    reach = _differ(n, n * den // num, num, den)  # the most differing tokens with any partner
    below = (-(-n * num // den) < 4 ** band) & (band > 0)  # a partner may be in the band below
    out_row, out_key = [], []
    for b, rows in [*[(x, np.flatnonzero((band == x) & (n > 0))) for x in np.unique(band)],
                    *[(x - 1, np.flatnonzero((band == x) & below)) for x in np.unique(band[below])]]:
        if not len(rows):
            continue
        lens = n[rows]
        at = np.repeat(s.start[rows] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
        token, own = s.token[at], np.repeat(np.arange(len(rows)), lens)
        top = 4 ** (int(b) + 1) - 1
        if top < SMALL:
            content, size = mix(token ^ _ONE), np.ones(len(token), dtype=np.int64)
        else:
            groups = int(_differ(top, top * den // num, num, den) * 3 // 2 + 8)
            group = (mix(token ^ _GROUP) >> np.uint64(20)).astype(np.int64) % groups
            order = np.argsort(own * groups + group, kind="stable")
            cell = (own * groups + group)[order]
            first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            size = np.diff(np.concatenate([first, [len(cell)]]))
            content = np.add.reduceat(mix(token[order] ^ _ONE), first)
            content = mix(content + (cell[first] % groups).astype(np.uint64))
            own = own[order][first]
        order = np.lexsort((content, -size, own))
        own, content = own[order], content[order]
        start = np.searchsorted(own, np.arange(len(rows)))
        take = np.arange(len(own)) - start[own] <= reach[rows][own]
        out_row.append(rows[own[take]])
        out_key.append(mix(content[take] ^ np.uint64(int(b) * 2654435761 + 1)))
    if not out_row:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(out_row), np.concatenate(out_key)


# ------------------------------------------------------------ R-tree
class CountTree:
    """R-tree over count vectors, packed bottom-up (sort, tile, group)."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        order = np.arange(len(points))
        order = self._tile(points, order)
        self.order = order
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [
            (points[order], sizes[order], sizes[order])]  # upper corner, least and greatest size
        while len(self.levels[-1][0]) > LEAF:
            up, lo, hi = self.levels[-1]
            at = np.arange(0, len(up), LEAF)
            self.levels.append((np.maximum.reduceat(up, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)))

    def _tile(self, points: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Halve along the coordinate of the largest spread until a leaf is left."""
        todo, out = [order], []
        while todo:
            part = todo.pop()
            if len(part) <= LEAF:
                out.append(part)
                continue
            p = points[part]
            d = int((p.max(axis=0) - p.min(axis=0)).argmax())
            part = part[np.argsort(p[:, d], kind="stable")]
            half = (len(part) // 2 + LEAF - 1) // LEAF * LEAF
            todo += [part[half:], part[:half]]
        return np.concatenate(out)

    def search(self, points: np.ndarray, sizes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) pairs whose bound allows J >= num/den."""
        top = len(self.levels[-1][0])
        q = np.repeat(np.arange(len(points)), top)
        node = np.tile(np.arange(top), len(points))
        for level in range(len(self.levels) - 1, -1, -1):
            up, lo, hi = self.levels[level]
            keep = []
            step = max(1, ELEMENTS // points.shape[1])
            for a in range(0, len(q), step):
                qa, na = q[a:a + step], node[a:a + step]
                n = sizes[qa]
                most = np.minimum(points[qa], up[na]).sum(axis=1)
                # J = i / (n + m - i) >= num / den with some m in lo..hi and i <= most
                ok = (den * lo[na] >= num * n) | (den * hi[na] >= num * n)
                ok &= den * n >= num * lo[na]
                ok &= (den + num) * most >= num * (n + lo[na])
                keep.append(ok)
            keep = np.concatenate(keep) if keep else np.zeros(0, dtype=bool)
            q, node = q[keep], node[keep]
            if level:
                below = len(self.levels[level - 1][0])
                q = np.repeat(q, LEAF)
                node = (node[:, None] * LEAF + np.arange(LEAF)).ravel()
                q, node = q[node < below], node[node < below]
        return q, self.order[node]


# ------------------------------------------------------------ join
def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = docs[text_col].cast("string")
    return docs.select(docs[id_col].alias("d"), F.xxhash64(text).alias("t"), text.alias("text"))


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def set_table(rows: DataFrame, n: int) -> DataFrame:
    """(d, t, c, n): the id and size of each text's set; size 0 for a null text or one without words."""
    schema = T.StructType([rows.schema["d"], rows.schema["t"], T.StructField("c", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_ranges(batch.column(2)):
                s = ShingleSets(texts, n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), _long(s.ids()), pa.array(s.size)],
                    names=["d", "t", "c", "n"])

    return rows.mapInArrow(run, schema)


def partition_table(rows: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(p, c, n): the partitions of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in text_ranges(batch.column(0)):
                s = ShingleSets(texts, n)
                row, key = partitions(s, num, den)
                yield pa.RecordBatch.from_arrays([_long(key), _long(s.ids()[row]), pa.array(s.size[row].astype(np.int32))],
                                                 names=["p", "c", "n"])

    return rows.select("text").mapInArrow(run, "p long, c long, n int")


def vector_table(rows: DataFrame, n: int) -> DataFrame:
    """(c, n, tokens, counts) of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in text_ranges(batch.column(0)):
                s = ShingleSets(texts, n)
                ends = np.concatenate([s.start, [len(s.token)]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [_long(s.ids()), pa.array(s.size.astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(ends), _long(s.token)), pa.array(s.counts(), pa.binary())],
                    names=["c", "n", "tokens", "counts"])

    return rows.select("text").mapInArrow(run, "c long, n int, tokens array<bigint>, counts binary")


def _verified(pairs: DataFrame, vectors: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, linked) of the pairs, decided on the sets."""
    left = vectors.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = vectors.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb")).cast("long")
    return pairs.join(left, "a").join(right, "b").select(
        "a", "b", (both * den >= (F.col("na") + F.col("nb") - both) * num).alias("linked"))


def _sizes_allow(a: str, b: str, num: int, den: int):
    return (F.col(a).cast("long") * den >= F.col(b).cast("long") * num) & (
        F.col(b).cast("long") * den >= F.col(a).cast("long") * num)


def _distinct_partitions(members: DataFrame) -> DataFrame:
    """``members`` without partitions that hold the same sets as another one."""
    h = F.xxhash64("c")
    same = members.groupBy("p").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(h).alias("x"),
                                    F.bit_xor(F.xxhash64(h, F.lit(1))).alias("y"))
    one = stash(same.groupBy("m", "x", "y").agg(F.min("p").alias("_p")).select("_p"), "distinct-partitions")
    out = stash(members.join(one, F.col("p") == F.col("_p")).drop("_p"), "members")
    discard(one)
    return out


def _tree_pairs(members: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b), a < b, of different components in one partition that pass the bounds.

    A partition of m members (``sizes``: p, m) is cut into blocks of about BLOCK; every pair of
    blocks is a task of its own, with an R-tree over one and the other as queries. Where
    ``members`` carry the halves of their tokens, the overlap on these is a second bound.
    """
    at = sizes.select(F.col("p").alias("_p"), F.ceil(F.col("m") / BLOCK).cast("int").alias("k"))
    m = members.join(at, F.col("p") == F.col("_p")).drop("_p")
    m = m.withColumn("block", F.pmod(F.xxhash64("c"), F.col("k")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    m = m.select("p", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "c", "n",
                 "component", "counts", *(["halves"] if "halves" in members.columns else []))

    schema = "a long, b long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            starts = _group_starts(rows)
            if len(starts) > 1:  # the last group may go on in the next batch
                yield from _search(rows.slice(0, starts[-1]), num, den)
                rest = rows.slice(starts[-1])
            else:
                rest = rows
        if rest is not None and len(rest):
            yield from _search(rest, num, den)

    return m.repartition("p", "i", "j").sortWithinPartitions("p", "i", "j").mapInArrow(run, schema).distinct()


def _group_starts(rows: pa.Table) -> np.ndarray:
    key = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in ("p", "i", "j")])
    return np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))


class Vectors:
    """Count vectors of rows, of several numbers of groups."""

    def __init__(self, column: pa.ChunkedArray):
        raw = column.to_pylist()
        self.dims = np.array([len(r) // 2 for r in raw])
        self.place, self.grid = np.zeros(len(raw), dtype=np.int64), {}
        for d in np.unique(self.dims):
            at = np.flatnonzero(self.dims == d)
            self.place[at] = np.arange(len(at))
            self.grid[d] = np.frombuffer(b"".join([raw[i] for i in at]), dtype="<u2").reshape(-1, d)

    def folded(self, rows: np.ndarray, dims: int) -> np.ndarray:
        """Vectors of ``rows`` in ``dims`` groups, none of which has fewer."""
        out = np.zeros((len(rows), dims), dtype=np.int32)
        for d in np.unique(self.dims[rows]):
            mine = self.dims[rows] == d
            out[mine] = self.grid[d][self.place[rows[mine]]].reshape(-1, d // dims, dims).sum(axis=1, dtype=np.int32)
        return out


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indexes start..start + size - 1 of all ranges, one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Halves:
    """Sets of rows as the upper halves of their sorted token hashes."""

    def __init__(self, column: pa.ChunkedArray):
        lists = column.combine_chunks()
        self.values = lists.flatten().to_numpy()
        self.size = pc.list_value_length(lists).to_numpy()
        self.start = np.cumsum(self.size) - self.size

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of the pairs, or more where halves of different tokens are equal."""
        rows, at = np.unique(np.concatenate([x, y]), return_inverse=True)
        if len(x) > 8 * len(rows):
            return self._by_products(rows, at[:len(x)], at[len(x):])
        out = np.zeros(len(x), dtype=np.int64)
        part = np.cumsum(self.size[x] + self.size[y]) // ELEMENTS
        edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(x) else np.zeros(1, dtype=int)
        for a, b in zip(edge[:-1], edge[1:]):
            both = np.concatenate([x[a:b], y[a:b]])
            token = self.values[_ranges(self.start[both], self.size[both])]
            pair = np.repeat(np.tile(np.arange(b - a), 2), self.size[both])
            order = np.lexsort((token, pair))
            token, pair = token[order], pair[order]
            same = (token[1:] == token[:-1]) & (pair[1:] == pair[:-1])
            out[a:b] = np.bincount(pair[1:][same], minlength=b - a)
        return out

    def _by_products(self, rows: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For many pairs of few rows: products of their incidence with the tokens that rows share."""
        size = self.size[rows]
        own = np.repeat(np.arange(len(rows)), size)
        _, token, count = np.unique(self.values[_ranges(self.start[rows], size)], return_inverse=True, return_counts=True)
        shared = np.cumsum(count > 1) - 1
        use = count[token] > 1
        own, token = own[use], shared[token[use]]
        order = np.argsort(token, kind="stable")
        own, token = own[order], token[order]
        total = np.zeros((len(rows), len(rows)), dtype=np.float32)  # exact: below 2^24 tokens a pair and slab
        for a in range(0, int(token[-1]) + 1 if len(token) else 0, SLAB):
            lo, hi = np.searchsorted(token, [a, a + SLAB])
            m = np.zeros((len(rows), SLAB), dtype=np.float32)
            np.add.at(m, (own[lo:hi], token[lo:hi] - a), 1.0)
            total += m @ m.T
        return total[x, y].astype(np.int64)


def forest_pairs(vectors: Vectors, n: np.ndarray, start: np.ndarray, size: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(x, y) pairs of rows of one group within the bound, for many small groups at once.

    Each group is a tree of leaves of ``LEAF`` rows in the order of their sizes under one root. A
    leaf's upper corner bounds the overlap of a row with all its members before they are read.
    """
    rows = _ranges(start, size)
    group = np.repeat(np.arange(len(start)), size)
    order = np.lexsort((n[rows], group))
    rows = rows[order]
    begin = np.cumsum(size) - size
    dims = np.minimum.reduceat(vectors.dims[rows], begin)
    for d in np.unique(dims):
        mine = np.flatnonzero(dims == d)
        part = np.cumsum(size[mine]) * int(d) // ELEMENTS
        edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        for a, b in zip(edge[:-1], edge[1:]):
            g = mine[a:b]
            at = rows[_ranges(begin[g], size[g])]
            grid, length = vectors.folded(at, int(d)), n[at]
            ends = np.cumsum(size[g])
            leaves = -(-size[g] // LEAF)
            leaf = _ranges(np.zeros(len(g), dtype=np.int64), leaves) * LEAF + np.repeat(ends - size[g], leaves)
            up, lo, hi = np.maximum.reduceat(grid, leaf), np.minimum.reduceat(length, leaf), np.maximum.reduceat(length, leaf)
            last = np.append(leaf[1:], len(at))
            asked = np.repeat(ends, leaves) - leaf  # rows from the leaf's first on: pairs are found once
            node, q = np.repeat(np.arange(len(leaf)), asked), _ranges(leaf, asked)
            for k in range(0, len(q), max(1, ELEMENTS // int(d))):
                nk, qk = node[k:k + max(1, ELEMENTS // int(d))], q[k:k + max(1, ELEMENTS // int(d))]
                ok = (den + num) * np.minimum(grid[qk], up[nk]).sum(axis=1) >= num * (length[qk] + lo[nk])
                ok &= (den * hi[nk] >= num * length[qk]) & (den * length[qk] >= num * lo[nk])
                nk, qk = nk[ok], qk[ok]
                x, y = (leaf[nk][:, None] + np.arange(LEAF)).ravel(), np.repeat(qk, LEAF)
                ok = (x < np.repeat(last[nk], LEAF)) & (x < y)
                x, y = x[ok], y[ok]
                ok = (den * length[x] >= num * length[y]) & (den * length[y] >= num * length[x])
                x, y = x[ok], y[ok]
                for z in range(0, len(x), max(1, ELEMENTS // int(d))):
                    xz, yz = x[z:z + max(1, ELEMENTS // int(d))], y[z:z + max(1, ELEMENTS // int(d))]
                    ok = (den + num) * np.minimum(grid[xz], grid[yz]).sum(axis=1) >= num * (length[xz] + length[yz])
                    yield at[xz[ok]], at[yz[ok]]


def _search(rows: pa.Table, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs within the groups of ``rows`` that pass the bounds: small groups' trees stand side by
    side in a forest, each larger group has a tree of its own."""
    i, j, block, c, n, component = (rows.column(x).to_numpy().astype(np.int64) for x in ("i", "j", "block", "c", "n", "component"))
    vectors = Vectors(rows.column("counts"))
    halves = Halves(rows.column("halves")) if "halves" in rows.column_names else None
    start = _group_starts(rows)
    size = np.diff(np.concatenate([start, [len(c)]]))

    def told(x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        ok = component[x] != component[y]
        ok &= (i[x] == j[x]) | (block[x] != block[y])  # two blocks: only pairs between them
        x, y = x[ok], y[ok]
        if halves is not None:
            both = halves.common(x, y)
            ok = both * den >= (n[x] + n[y] - both) * num
            x, y = x[ok], y[ok]
        if len(x):
            a, b = c[x], c[y]
            ab = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ab[0]), pa.array(ab[1])], names=["a", "b"])

    small = size <= TOGETHER
    if small.any():
        for x, y in forest_pairs(vectors, n, start[small], size[small], num, den):
            yield from told(x, y)
    for s, m in zip(start[~small], size[~small]):
        at = np.arange(s, s + m)
        x, y = at[block[at] == i[s]], at[block[at] == j[s]]
        if len(x) and len(y):
            dims = vectors.dims[at].min()
            q, p = CountTree(vectors.folded(x, dims), n[x]).search(vectors.folded(y, dims), n[y], num, den)
            q, p = y[q], x[p]
            if i[s] == j[s]:
                q, p = q[q < p], p[q < p]
            yield from told(q, p)


def similarity_components(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id",
                          text_col: str = "text") -> DataFrame:
    """(id, n_shingles, class_id, component_id) of every row of ``docs``.

    Rows link when ``den`` * intersection >= ``num`` * union of their sets of ``words``-word
    shingles (A-Z lower-cased; a text with fewer words has its whole sequence as one shingle).
    ``component_id`` is the smallest key reachable by links. A null text or one without words
    has no shingle and links with nothing; repeated rows have equal sets and link. Null keys
    are never the smallest unless a component has no other. Sets are compared as 64-bit
    hashes of shingles and identified by 64-bit hashes.
    """
    out = _components(docs, words, num, den, id_col, text_col)
    return out.select(F.col("d").alias(id_col), F.col("n").alias("n_shingles"), F.col("c").alias("class_id"),
                      F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("d")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one of the smallest key (nulls last), of
    equal keys the one of the smallest text hash, of rows equal in both the one whose columns,
    written as JSON, come first. Rows without a word stay, all of them.
    """
    out = _components(docs, words, num, den, id_col, text_col)
    key = F.coalesce(F.col("d").cast("string"), F.lit(""))
    order = F.struct(F.col("d").isNull().alias("x"), F.col("d").alias("d"), F.col("t").alias("t"))
    chosen = out.where("n > 0").groupBy("component").agg(F.min(order).alias("o")).select(
        F.coalesce(F.col("o.d").cast("string"), F.lit("")).alias("_key"), F.col("o.t").alias("_hash"))
    # how often a row of the chosen key and text stands; wordless rows all stay
    same = out.where("n > 0").groupBy(key.alias("_k"), F.col("t").alias("_t")).agg(F.count(F.lit(1)).alias("_rows"))
    chosen = chosen.join(same, (F.col("_key") == F.col("_k")) & (F.col("_hash") == F.col("_t"))).select("_key", "_hash", "_rows")
    wordless = out.where("n = 0").select(key.alias("_key"), F.col("t").alias("_hash"), F.lit(0).cast("long").alias("_rows")).distinct()
    k, t, m = (unused(c, docs.columns) for c in ("_key", "_hash", "_rows"))
    rows = docs.withColumns({k: F.coalesce(docs[id_col].cast("string"), F.lit("")), t: F.xxhash64(docs[text_col].cast("string"))})
    kept = stash(chosen.unionByName(wordless), "kept").withColumnsRenamed({"_key": f"{k}_2", "_hash": f"{t}_2", "_rows": m})
    on = (rows[k] == kept[f"{k}_2"]) & (rows[t] == kept[f"{t}_2"])
    single = rows.join(kept.where(F.col(m) <= 1), on).select(*docs.columns)
    if kept.where(F.col(m) > 1).isEmpty():
        return single
    # of rows equal in key and text the one whose columns, as JSON, come first
    whole = F.struct(*[F.col(c) for c in docs.columns])
    one = rows.join(kept.where(F.col(m) > 1), on).groupBy(k, t).agg(F.min_by(whole, F.to_json(whole)).alias(m))
    return single.unionByName(one.select(f"{m}.*"))


def _components(docs: DataFrame, words: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """(d, t, c, n, component, low) of every row: key, text hash, class and size of the set, the
    component's smallest class, its smallest key; the last two are null where n is 0."""
    rows = _texts(docs, id_col, text_col)
    sets = stash(set_table(rows, words), "sets")
    placed = partition_table(rows, words, num, den)
    shared = placed.groupBy("p").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.count(F.lit(1)).alias("m")).where("x <> y")
    shared = stash(shared.select(F.col("p").alias("_p"), F.least("m", F.lit((1 << 31) - 1)).cast("int").alias("m")), "partitions")
    together = stash(placed.join(shared, F.col("p") == F.col("_p")).select("p", "c", "n", "m").distinct(), "members")
    discard(shared)
    members = _distinct_partitions(together.select("p", "c", "n"))
    # how many texts a class meets in its partitions: what the first star's hubs are chosen by
    meets = stash(together.groupBy("c").agg(F.sum("m").alias("meets")), "meets")
    discard(together)

    # the sets of the classes that share a partition, one text each
    low = stash(sets.where("n > 0").groupBy("c").agg(F.min("d").alias("d")), "classes")
    wanted = low.join(meets.select("c"), "c").where(F.col("d").isNotNull())
    wanted = stash(wanted.select(F.col("d").alias("_d")), "wanted")
    texts = rows.join(wanted, F.col("d") == F.col("_d")).select("text")
    texts = texts.unionByName(rows.where(F.col("d").isNull()).select("text"))
    vectors = vector_table(texts, words).join(meets.select("c"), "c", "left_semi").dropDuplicates(["c"])
    vectors = stash(vectors, "vectors")
    discard(wanted)

    component = stash(meets.select("c", F.col("c").alias("component")), "component")
    links, tables = None, []
    for step in range(STARS + 1):
        named = component.withColumnRenamed("c", "_c")
        labelled = members.join(named, F.col("c") == F.col("_c")).drop("_c")
        if step == 0:
            score = meets.withColumnRenamed("c", "_c")
            labelled = labelled.join(score, F.col("c") == F.col("_c")).drop("_c")
        else:
            labelled = labelled.withColumn("meets", F.xxhash64("c", F.lit(step)))
        open_ = labelled.groupBy("p").agg(
            F.min("component").alias("x"), F.max("component").alias("y"),
            F.max_by(F.struct("c", "n", "component"), F.struct("meets", "c")).alias("hub")).where("x <> y")
        open_ = stash(open_.select(F.col("p").alias("_p"), "hub"), "open-partitions")
        if open_.isEmpty():
            break
        inside = labelled.join(open_, F.col("p") == F.col("_p")).drop("meets")
        if step < STARS:
            pairs = inside.where((F.col("component") != F.col("hub.component")) & _sizes_allow("n", "hub.n", num, den)).select(
                F.least("c", "hub.c").alias("a"), F.greatest("c", "hub.c").alias("b")).distinct()
        else:
            inside = inside.drop("hub", "_p")
            sizes = stash(inside.groupBy("p").agg(F.count(F.lit(1)).alias("m")), "open-sizes")
            half = F.transform("tokens", lambda x: F.shiftright(x, 32).cast("int")).alias("halves")
            found = []
            for part, carried in ((F.col("m") <= MANY, ["counts"]), (F.col("m") > MANY, ["counts", half])):
                some = sizes.where(part)
                here = inside.join(some.select(F.col("p").alias("_p")), F.col("p") == F.col("_p")).drop("_p")
                here = here.join(vectors.select(F.col("c").alias("_c"), *carried), F.col("c") == F.col("_c")).drop("_c")
                found.append(_tree_pairs(here, some, num, den))
            pairs = found[0].unionByName(found[1]).distinct()
        pairs = stash(pairs, "pairs")
        found = stash(_verified(pairs, vectors, num, den).where("linked").select("a", "b"), "links")
        discard(pairs)
        if step == STARS:
            discard(sizes)
        discard(open_)
        tables.append(found)
        if found.isEmpty():
            continue
        links = found if links is None else links.unionByName(found)
        reached = connected(links)
        new = stash(meets.select("c").join(reached.select(F.col("node").alias("c"), "component"), "c", "left").select(
            "c", F.coalesce("component", "c").alias("component")), "component")
        discard(component)
        component = new
    if links is None:
        named = low.select("c", F.col("c").alias("component"), F.col("d").alias("low"))
    else:
        label = low.join(component.withColumnRenamed("c", "_c"), F.col("c") == F.col("_c"), "left").select(
            "c", "d", F.coalesce("component", "c").alias("component"))
        least = stash(label.groupBy("component").agg(F.min("d").alias("low")), "component-low")
        named = label.join(least, "component").select("c", "component", "low")
    named = stash(named, "class-name")
    discard(members, meets, vectors, component, low, *tables)
    named = named.withColumnRenamed("c", "_c")
    return sets.join(named, (F.col("n") > 0) & (F.col("c") == F.col("_c")), "left").drop("_c")
