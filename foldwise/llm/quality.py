"""Quality classifier: a factorisation machine over hashed words and text statistics.

score(x) = sigmoid(b + sum_j w_j x_j + 1/2 sum_f [(sum_j v_jf x_j)^2 - sum_j v_jf^2 x_j^2])

The bracket equals the sum of all pairwise interactions <v_i, v_j> x_i x_j, so a document
is scored in time linear in its words. Features: hashed words with their share of the
document, statistics of its structure (shape of words, lines, marks, repetition) as
values and as bins, and its length as metadata.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD_BITS = 14
BINS = 8
RANK = 8
SAMPLE_PER_CLASS = 4000   # labelled documents per class that training reads at most, in expectation
EPOCHS = 12
THRESHOLD = 0.3
KNOWN_WORDS = 100_000     # words whose buckets a task keeps before it starts anew

# Byte classes: 0 other, 1 upper case, 2 lower case, 3 digit, 4 space, 5 end of sentence, 6 mark, 7 symbol, 8 beyond ASCII
_CLASS = np.zeros(256, dtype=np.uint8)
for _k, _s in ((1, range(65, 91)), (2, range(97, 123)), (3, range(48, 58)), (4, b" \t\n\r\x0b\x0c"), (5, b".?"),
               (6, b",;:'\"()-"), (7, b"#*$%&|<>!@^_~=+/\\{}[]"), (8, range(128, 256))):
    _CLASS[list(_s)] = _k
N_STATS = 16


def stats_and_words(text: str | None, known: dict[bytes, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(statistics, distinct word buckets, their shares of the words) of one whole text;
    ``known`` keeps the buckets of words met before."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    known = {} if known is None else known
    if len(known) > KNOWN_WORDS:
        known.clear()
    ids = []
    for w in words:
        i = known.get(w)
        if i is None:
            i = known[w] = zlib.crc32(w.strip(b".,;:!?").lower()) & ((1 << WORD_BITS) - 1)
        ids.append(i)
    arr = np.array(ids, dtype=np.int64)
    n, size = len(words), len(raw)
    s = np.zeros(N_STATS)
    s[0] = np.log1p(n)
    if n:
        cls = np.bincount(_CLASS[np.frombuffer(raw, dtype=np.uint8)], minlength=9)
        s[1:9] = cls[[1, 2, 3, 5, 6, 7, 8, 0]] / size
        s[9] = np.log(size / n)
        s[10] = np.mean(arr[1:] == arr[:-1]) if n > 1 else 0.0
        s[15] = sum(1 for w in words if len(w) == 1) / n
        lines = [x for x in raw.split(b"\n") if x.strip()]
        s[12] = 1 - len(set(lines)) / len(lines)
        s[13] = np.log1p(n / len(lines))
        s[14] = np.log1p(len(lines))
    uniq, count = np.unique(arr, return_counts=True)
    s[11] = len(uniq) / n if n else 0.0
    return s, uniq, count / max(n, 1)


def _rows(parts: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]]):
    lens = np.array([len(p[1]) for p in parts])
    return (np.stack([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64),
            np.concatenate([p[2] for p in parts]), lens)


def _sum_by(values: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Sums over consecutive runs of ``lens`` rows (every run has some)."""
    return np.add.reduceat(values, np.cumsum(lens) - lens, axis=0)


@dataclass
class FactorisationMachine:
    """Weights over word buckets, then statistics, then bins of the statistics."""

    mean: np.ndarray
    scale: np.ndarray
    edges: np.ndarray          # N_STATS x (BINS - 1)
    bias: float
    w: np.ndarray
    v: np.ndarray

    def design(self, stats: np.ndarray, words: np.ndarray, share: np.ndarray, lens: np.ndarray):
        """Flat (feature, value) pairs and the number of pairs of each row."""
        n = len(stats)
        z = np.clip((stats - self.mean) / self.scale, -4, 4) * 0.5
        base = 1 << WORD_BITS
        bins = (stats[:, :, None] > self.edges[None]).sum(axis=2)
        dense_f = np.concatenate([np.broadcast_to(base + np.arange(N_STATS), (n, N_STATS)),
                                  base + N_STATS + np.arange(N_STATS) * BINS + bins], axis=1)
        dense_x = np.concatenate([z, np.full((n, N_STATS), 0.5)], axis=1)
        k = dense_f.shape[1]
        f = np.empty(len(words) + n * k, dtype=np.int64)
        x = np.empty(len(f))
        starts = np.cumsum(lens + k) - (lens + k)
        at = (starts[:, None] + np.arange(k)).ravel()
        rest = np.ones(len(f), dtype=bool)
        rest[at] = False
        f[at], x[at] = dense_f.ravel(), dense_x.ravel()
        f[rest], x[rest] = words, share * 4
        return f, x, lens + k

    def forward(self, f: np.ndarray, x: np.ndarray, lens: np.ndarray):
        vx = self.v[f] * x[:, None]
        s = _sum_by(vx, lens)
        return self.bias + _sum_by(self.w[f] * x, lens) + 0.5 * (s ** 2 - _sum_by(vx ** 2, lens)).sum(axis=1), s, vx

    def score(self, parts) -> np.ndarray:
        f, x, lens = self.design(*_rows(parts))
        return 1 / (1 + np.exp(-np.clip(self.forward(f, x, lens)[0], -30, 30)))


def train(parts, label: np.ndarray, weight: np.ndarray, seed: int = 3) -> FactorisationMachine:
    """Weighted logistic loss, Adagrad over mini-batches; the same rows give the same weights."""
    stats = np.stack([p[0] for p in parts])
    rng = np.random.default_rng(seed)
    size = (1 << WORD_BITS) + N_STATS * (1 + BINS)
    q = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T
    fm = FactorisationMachine(stats.mean(axis=0), stats.std(axis=0) + 1e-3, q, 0.0, np.zeros(size),
                              rng.normal(0, 0.02, (size, RANK)))
    gw, gv, gb = np.full(size, 1e-2), np.full((size, RANK), 1e-2), 1e-2
    weight = weight / weight.mean()
    for epoch in range(EPOCHS):
        order = rng.permutation(len(parts))
        for at in range(0, len(order), 64):
            idx = order[at:at + 64]
            f, x, lens = fm.design(*_rows([parts[i] for i in idx]))
            y, s, vx = fm.forward(f, x, lens)
            err = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - label[idx]) * weight[idx] / len(idx)
            owner = np.repeat(np.arange(len(idx)), lens)
            e = err[owner] * x
            u, inv = np.unique(f, return_inverse=True)
            dw = np.bincount(inv, weights=e, minlength=len(u)) + 1e-5 * fm.w[u]
            dv = np.stack([np.bincount(inv, weights=e * (s[owner, k] - vx[:, k]), minlength=len(u))
                           for k in range(RANK)], axis=1) + 1e-5 * fm.v[u]
            gw[u] += dw ** 2
            gv[u] += dv ** 2
            fm.w[u] -= 0.1 * dw / np.sqrt(gw[u])
            fm.v[u] -= 0.03 * dv / np.sqrt(gv[u])
            gb += err.sum() ** 2
            fm.bias -= 0.1 * err.sum() / np.sqrt(gb)
    return fm


def fit(docs: DataFrame, labels: DataFrame, trainable: Column, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality") -> FactorisationMachine | None:
    """Learn from a bounded sample of labelled documents.

    ``trainable`` is a condition on the key. Labels of one key are averaged (0.5 counts as
    1); null keys and labels are left out. Of each class about ``SAMPLE_PER_CLASS`` keys are
    chosen by a hash and weighted back to the class's share, so scores stay calibrated.
    None where no document of either class is found.
    """
    rows = labels.select(F.col(id_col), F.col(label_col).cast("double").alias("_y")).where(
        trainable & F.col(id_col).isNotNull() & F.col("_y").isNotNull())
    rows = rows.groupBy(id_col).agg((F.avg("_y") >= 0.5).cast("int").alias("_y"))
    counts = {r[0]: r[1] for r in rows.groupBy("_y").count().collect()}
    if len(counts) < 2:
        return None
    h = F.pmod(F.xxhash64(F.col(id_col), F.lit(8)), F.lit(1 << 30))
    share = {y: min(1.0, SAMPLE_PER_CLASS / n) for y, n in counts.items()}
    limit = F.when(F.col("_y") == 1, F.lit(share[1])).otherwise(F.lit(share[0])) * (1 << 30)
    chosen = F.broadcast(rows.where(h < limit))  # at most about 2 * SAMPLE_PER_CLASS rows of two numbers
    found = docs.select(id_col, F.col(text_col).cast("string").alias("_t")).join(chosen, id_col)
    schema = "h long, y int, stats array<double>, words array<int>, share array<float>"

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            got = [stats_and_words(t.as_py(), known) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([p[0] for p in got], pa.list_(pa.float64())),
                 pa.array([p[1] for p in got], pa.list_(pa.int32())), pa.array([p[2] for p in got], pa.list_(pa.float32()))],
                names=["h", "y", "stats", "words", "share"])

    sample = found.select(F.xxhash64(F.col(id_col), F.lit(9)).alias("h"), "_t", "_y").mapInArrow(features, schema)
    sample = sample.toArrow().sort_by([("h", "ascending")])
    label = sample["y"].to_numpy()
    if len(set(label.tolist())) < 2:
        return None
    parts = list(zip(*[[np.asarray(x.values) for x in sample[c]] for c in ("stats", "words", "share")]))
    weight = np.where(label == 1, 1 / share[1], 1 / share[0])
    return train(parts, label, weight)


def score(docs: DataFrame, model: FactorisationMachine | None, id_col: str = "doc_id", text_col: str = "text",
          keep: Sequence[str] = (), out: str = "score") -> DataFrame:
    """(id, kept columns, ``out``) of every row; 0.5 where nothing was learned.

    A null text scores as the empty text. Repeated rows are kept one by one.
    """
    cols = [id_col, *[c for c in keep if c != id_col]]
    text = cols.index(text_col) if text_col in cols else len(cols)
    rows = docs.select(*[F.col(c).cast("string").alias(c) if c == text_col else F.col(c) for c in cols],
                       *([] if text_col in cols else [F.col(text_col).cast("string").alias("_text")]))
    schema = T.StructType([*[rows.schema[c] for c in cols], T.StructField(out, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = shared.value, {}
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = part.column(text).to_pylist()
                s = m.score([stats_and_words(t, known) for t in texts]) if m else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays([*part.columns[:len(cols)], pa.array(s, pa.float64())],
                                                 names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)
