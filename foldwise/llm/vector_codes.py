"""Vector codes from exact integer codebooks, over Hilbert-sorted flat blocks.

Vectors become integers and are cut into parts. The parts of one position are sorted along a
Hilbert curve, so that a block of neighbours in this order lies in a small box; a block is one
flat row with its integers, its box and its sums. A round reads the blocks: an entry whose least
distance to a box exceeds another's greatest one, or which is farther than another one at every
point of the box, can own none of its parts, so each block tests a shortlist of entries. Where
one entry is left the stored sums are used and no part is looked at. All arithmetic is exact in
integers; only sums per entry and the codebooks come to the driver, both of fixed size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm.common import stash

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
BLOCK = 512        # parts of a block
LIMIT = 1 << 28    # integers of a component stay below: squared distances then fit 64 bits
EXACT = 1 << 53    # integers that doubles hold exactly


# ------------------------------------------------------------ Hilbert order
def hilbert_keys(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Place of each integer point on a Hilbert curve through the box ``low``..``high``, as a 64-bit
    number in signed order; points outside count as on its faces. Beyond 64 dimensions the widest
    64 are used: the keys only say which points become neighbours."""
    use = np.sort(np.argsort(low - high, kind="stable")[:64])
    bits = min(16, 64 // max(1, len(use)))
    width = np.maximum(high[use] - low[use] + 1, 1)
    x = (np.clip(points[:, use] - low[use], 0, width - 1) * (1 << bits) // width).astype(np.uint64)
    dims, one = x.shape[1], np.uint64(1)
    for b in range(bits - 1, 0, -1):  # undo the turns and reflections of each level
        q, low_bits = one << np.uint64(b), (one << np.uint64(b)) - one
        for i in range(dims):
            turn = (x[:, i] & q) != 0
            swap = np.where(turn, np.uint64(0), (x[:, 0] ^ x[:, i]) & low_bits)
            x[:, 0] ^= np.where(turn, low_bits, swap)
            x[:, i] ^= swap
    for i in range(1, dims):  # Gray code
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), dtype=np.uint64)
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        flip ^= np.where((x[:, dims - 1] & q) != 0, q - one, np.uint64(0)) if dims else flip
    x ^= flip[:, None]
    key = np.zeros(len(x), dtype=np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << one) | ((x[:, i] >> np.uint64(b)) & one)
    return (key ^ (one << np.uint64(63))).view(np.int64)


# ------------------------------------------------------------ kernels
def shortlist(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Ascending indexes of the entries that can be nearest to some point of the box."""
    under, over = low - entries, entries - high
    least = (np.maximum(np.maximum(under, over), 0) ** 2).sum(axis=1)
    greatest = (np.maximum(np.abs(under), np.abs(over)) ** 2).sum(axis=1)
    best = int(greatest.argmin())
    left = np.flatnonzero(least <= greatest[best])
    # the greatest lead that an entry can have over the best one anywhere in the box
    c, e = entries[best], entries[left]
    lead = ((c - e) * (c + e) + np.maximum(-2 * low * (c - e), -2 * high * (c - e))).sum(axis=1)
    return left[lead >= 0]


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) of each point; ties go to the lower index."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * max(1, points.shape[1]) * most * most < EXACT:
        p, e = points.astype(np.float64), entries.astype(np.float64)
        d = (e * e).sum(axis=1) - 2.0 * (p @ e.T)  # sums of integers that doubles hold
        at = d.argmin(axis=1)
        return at, (d[np.arange(len(p)), at] + (p * p).sum(axis=1)).astype(np.int64)
    at, least = np.zeros(len(points), dtype=np.int64), np.zeros(len(points), dtype=np.int64)
    for a in range(0, len(points), 64):
        d = ((points[a:a + 64, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        at[a:a + 64], least[a:a + 64] = d.argmin(axis=1), d.min(axis=1)
    return at, least


# ------------------------------------------------------------ blocks
def _integers(column: pa.Array, dim: int) -> np.ndarray:
    flat = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    x = np.floor(SCALE * flat)
    if len(x) and np.abs(x).max() >= LIMIT:
        raise ValueError(f"components of {LIMIT // SCALE} and more have no exact 64-bit distances")
    return x.astype(np.int64).reshape(-1, dim)


def block_table(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """One row per block: part, n, points, low, high, sums (binary), and per part of the block the
    row it belongs to, with the row's key and label at part 0.

    ``rows`` has the columns row, key, label and vector. The Hilbert box is that of ``books``. Equal
    parts are told apart by their row, so copies spread over blocks and tasks.
    """
    parts, _, width = books.shape
    key_type, label_type = rows.schema["key"].dataType, rows.schema["label"].dataType
    low, high = books.min(axis=1), books.max(axis=1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _integers(batch.column(3), parts * width)
            n = len(x)
            for p in range(parts):
                mine = np.ascontiguousarray(x[:, p * width:(p + 1) * width])
                raw = mine.astype("<i4").tobytes()
                raw = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * (4 * width)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, p, dtype=np.int32)), pa.array(hilbert_keys(mine, low[p], high[p])), batch.column(0),
                     *[batch.column(c) if p == 0 else pa.nulls(n, batch.column(c).type) for c in (1, 2)], raw],
                    names=["part", "place", "row", "key", "label", "point"])

    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType()), T.StructField("row", T.LongType()),
                           T.StructField("key", key_type), T.StructField("label", label_type), T.StructField("point", T.BinaryType())])
    placed = rows.select("row", "key", "label", "vector").mapInArrow(cut, schema)
    placed = placed.repartitionByRange("part", "place", "row").sortWithinPartitions("part", "place", "row")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column(0).to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]])
            starts = np.concatenate([np.arange(a, b, BLOCK) for a, b in zip(edges[:-1], edges[1:])]).astype(np.int64)
            ends = np.minimum(starts + BLOCK, edges[np.searchsorted(edges, starts, side="right")])
            if not len(part):
                continue
            points = np.frombuffer(b"".join(batch.column(5).to_pylist()), dtype="<i4").reshape(-1, width)
            out = []
            for a, b in zip(starts, ends):
                x = points[a:b].astype(np.int64)
                out.append((points[a:b].tobytes(), x.min(axis=0).tobytes(), x.max(axis=0).tobytes(), x.sum(axis=0).tobytes()))
            offsets = pa.array(np.concatenate([starts, ends[-1:]]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, batch.column(c)) for c in (2, 3, 4)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[starts]), pa.array((ends - starts).astype(np.int32)),
                 *[pa.array([o[k] for o in out], pa.binary()) for k in range(4)], *lists],
                names=["part", "n", "points", "low", "high", "sums", "rows", "keys", "labels"])

    flat = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("n", T.IntegerType()),
                         *[T.StructField(c, T.BinaryType()) for c in ("points", "low", "high", "sums")],
                         T.StructField("rows", T.ArrayType(T.LongType())), T.StructField("keys", T.ArrayType(key_type)),
                         T.StructField("labels", T.ArrayType(label_type))])
    return stash(placed.mapInArrow(build, flat), "code-blocks")


def _numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.int64)


def entry_sums(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, entry, n, sums) of the parts nearest to each entry; entries without parts are missing."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, width), dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            for part, n, raw, low, high, sums in zip(*[c.to_pylist() for c in batch.columns]):
                near = shortlist(_numbers(low), _numbers(high), books[part])
                if len(near) == 1:
                    total[part, near[0]] += _numbers(sums)
                    count[part, near[0]] += n
                    continue
                x = np.frombuffer(raw, dtype="<i4").reshape(n, width).astype(np.int64)
                at = nearest(x, books[part][near])[0]
                order = np.argsort(at, kind="stable")
                first = np.flatnonzero(np.diff(at[order], prepend=-1))
                total[part, near[at[order][first]]] += np.add.reduceat(x[order], first, axis=0)
                count[part] += np.bincount(near[at], minlength=entries)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))],
                                         names=["part", "entry", "n", "sums"])

    found = blocks.select("part", "n", "points", "low", "high", "sums").mapInArrow(run, "part long, entry long, n long, sums array<long>")
    return found.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).alias("sums"))


def train(blocks: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after ``rounds`` assignments; an entry becomes the floor of its parts' mean."""
    for _ in range(rounds):
        new = books.copy()
        for r in entry_sums(blocks, books).collect():  # parts x entries rows at most
            new[r.part, r.entry] = np.array(r.sums, dtype=np.int64) // r.n
        books = new
    return books


def assigned(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """(row, part, key, label, entry, error) of every part."""
    width = books.shape[2]
    key_type, label_type = (blocks.schema[c].dataType.elementType for c in ("keys", "labels"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, error = [], []
            for part, n, raw, low, high in zip(*[batch.column(c).to_pylist() for c in range(5)]):
                near = shortlist(_numbers(low), _numbers(high), books[part])
                a, d = nearest(np.frombuffer(raw, dtype="<i4").reshape(n, width).astype(np.int64), books[part][near])
                at.append(near[a])
                error.append(d)
            part = np.repeat(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays(
                [batch.column(5).flatten(), pa.array(part), batch.column(6).flatten(), batch.column(7).flatten(),
                 pa.array(np.concatenate(at).astype(np.int32)), pa.array(np.concatenate(error))],
                names=["row", "part", "key", "label", "entry", "error"])

    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("key", key_type),
                           T.StructField("label", label_type), T.StructField("entry", T.IntegerType()), T.StructField("error", T.LongType())])
    return blocks.select("part", "n", "points", "low", "high", "rows", "keys", "labels").mapInArrow(run, schema)


# ------------------------------------------------------------ operator
def _first_vectors(valid: DataFrame, entries: int, parts: int) -> np.ndarray | None:
    """(entries, dimension) integers of the smallest keys' vectors; at most ``entries`` rows."""
    sized = valid.where((F.size("vector") > 0) & (F.size("vector") % parts == 0))
    order = [F.col("key").asc_nulls_last(), F.col("vector")]
    first = sized.orderBy(*order).select(F.size("vector").alias("n")).first()
    if first is None:
        return None
    sized = sized.where(F.size("vector") == first.n)
    # by keys alone first: a task then merges short rows, and the vectors' scan is filtered
    keys = [r.key for r in sized.orderBy(F.col("key").asc_nulls_last()).select("key").limit(entries).collect()]
    if len(keys) == entries and keys[-1] is not None:
        sized = sized.where(F.col("key") <= F.lit(keys[-1]))
    x = np.array([r.vector for r in sized.orderBy(*order).limit(entries).select("vector").collect()], dtype=np.float64)
    return _integers(pa.array(list(x), pa.list_(pa.float64())), first.n)


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None]:
    """((id, code, error, label_error) of every kept vector, codebooks of shape part, entry, position).

    A vector goes if it is null or holds null or non-finite components; so does one whose length
    differs from that of the smallest key's vector, or is no positive multiple of ``parts``. The
    codebooks start as the parts of the ``entries`` smallest keys (null keys last, equal keys by
    vector; fewer vectors make fewer entries). Repeated rows each get a row. ``label_error`` sums
    ``error`` over equal labels, null ones together. Components of 2^18 and more are an error, as
    their squared distances need not fit 64 bits. Without kept vectors there are no rows and no
    codebooks. Other columns are not read.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits per part: 256 entries at most")
    rows = vectors.select(vectors[id_col].alias("key"), vectors[label_col].alias("label"),
                          vectors[vector_col].cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = rows.where(F.col("vector").isNotNull() & finite)
    first = _first_vectors(valid, entries, parts)
    if first is None:
        none = valid.where("false").select(F.col("key").alias(id_col), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                                           F.lit(0).cast("long").alias("label_error"))
        return none, None
    books = first.reshape(len(first), parts, -1).transpose(1, 0, 2)
    kept = valid.where(F.size("vector") == first.shape[1]).withColumn("row", F.monotonically_increasing_id())
    blocks = block_table(kept, books)
    books = train(blocks, books, rounds)
    code = F.concat(*[F.lpad(F.lower(F.hex(F.max(F.when(F.col("part") == p, F.col("entry"))))), 2, "0") for p in range(parts)])
    out = stash(assigned(blocks, books).groupBy("row").agg(
        F.max("key").alias("key"), F.max("label").alias("label"), code.alias("code"), F.sum("error").alias("error")), "codes")
    by_label = out.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    out = out.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return out.select(F.col("key").alias(id_col), "code", "error", "label_error"), books


def books_sha256(books: np.ndarray | None) -> str:
    """SHA-256 of all components as decimal integers, joined by commas, by part, entry, position."""
    return hashlib.sha256(",".join(map(str, [] if books is None else books.ravel().tolist())).encode()).hexdigest()
