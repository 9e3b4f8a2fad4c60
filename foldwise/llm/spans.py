"""Substring dedup by sliding sentence spans.

A text is cut into sentences: at marks that end a sentence and at line ends; in a long
sentence also at its inner marks and after ``MAX_WORDS`` words, so a shared passage of few
marks has several sentences and lines up again soon after its edge. From every sentence on
the shortest run of at least ``SPAN`` consecutive sentences and ``MIN_WORDS`` words is hashed;
with ``both_ends`` also the shortest such run that ends with the sentence, so a repeated
passage is covered up to its last whole sentence and an exact copy loses everything.
A grouped count over all texts finds the hashes that occur more than once; the places of
those are joined back, and the sentences of every place but the first are removed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm.common import stash, unused
from foldwise.llm.words import Words, mix, run_hash, text_ranges

SPAN = 2         # fewest consecutive sentences of a span
MIN_WORDS = 20   # fewest words of a span: above single lines that many documents share, below half a passage of 50
MAX_WORDS = 16   # words after which a sentence is cut
INNER_FROM = 6   # an inner mark cuts a sentence that has this many words by then

_END, _INNER = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_END[list(b".!?")] = True
_INNER[list(b",;:")] = True


def _since(breaks: np.ndarray) -> np.ndarray:
    """Words since the last break before each word (``breaks`` marks the last word of a part)."""
    n = np.arange(len(breaks))
    begin = np.concatenate([[True], breaks[:-1]])
    return n - np.maximum.accumulate(np.where(begin, n, 0))


class Sentences:
    """Sentences of a batch of texts: row, number in the text, words, byte range, hash."""

    def __init__(self, texts: Sequence[str | None]):
        w = self.w = Words(texts)
        n = len(w.start)
        if not n:
            self.row = self.pos = self.words = self.begin = self.stop = np.zeros(0, dtype=np.int64)
            self.hash = np.zeros(0, dtype=np.uint64)
            return
        tail = w.data[w.end - 1]
        lines = np.cumsum(w.data == 10)
        hard = _END[tail]
        hard[:-1] |= lines[w.start[1:]] > lines[w.end[:-1] - 1]
        hard[-1] = True
        cut = hard | (_INNER[tail] & (_since(hard) >= INNER_FROM - 1))
        cut |= _since(cut) % MAX_WORDS == MAX_WORDS - 1
        first = np.flatnonzero(np.concatenate([[True], cut[:-1]]))
        self.words = np.diff(np.concatenate([first, [n]]))
        self.hash = run_hash(w.hash, first, self.words)
        self.row = w.row[first]
        new = np.concatenate([[True], self.row[1:] != self.row[:-1]])
        k = np.arange(len(first))
        self.pos = k - np.maximum.accumulate(np.where(new, k, 0))
        # a sentence reaches to the next one's first word; the first of a text starts with the text
        self.begin = np.where(new, w.text_start[self.row], w.start[first])
        self.stop = np.concatenate([self.begin[1:], [0]])
        ends = np.concatenate([new[1:], [True]])
        self.stop = np.where(ends, w.text_start[self.row + 1] - 1, self.stop)

    def ends(self) -> np.ndarray:
        """For each sentence the end (exclusive) of the span that begins there, 0 where the text
        has not enough sentences or words left."""
        n = len(self.row)
        total = np.concatenate([[0], np.cumsum(self.words)])
        end = np.searchsorted(total, total[:-1] + MIN_WORDS, side="left")
        end = np.maximum(end, np.arange(n) + SPAN)
        last = np.searchsorted(self.row, self.row, side="right")
        return np.where(end <= last, end, 0)

    def begins(self) -> np.ndarray:
        """For each sentence the begin of the span that ends with it, -1 where the text has not
        enough sentences or words before."""
        n = len(self.row)
        total = np.concatenate([[0], np.cumsum(self.words)])
        begin = np.searchsorted(total, total[1:] - MIN_WORDS, side="right") - 1
        begin = np.minimum(begin, np.arange(n) + 1 - SPAN)
        first = np.searchsorted(self.row, self.row, side="left")
        return np.where(begin >= first, begin, -1)

    def spans(self, both_ends: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(index of the first sentence, sentences, hash, second hash) of the spans, each once."""
        ends = self.ends()
        at = np.flatnonzero(ends)
        end = ends[at]
        if both_ends:
            begins = self.begins()
            last = np.flatnonzero(begins >= 0)
            last = last[ends[begins[last]] != last + 1]
            at, end = np.concatenate([at, begins[last]]), np.concatenate([end, last + 1])
        out = []
        for base, seed in ((0x9E3779B97F4A7C15, 0), (0xD1B54A32D192ED03, 0x5851F42D4C957F2D)):
            # the hash of a run is its polynomial, taken from running sums: sum of s_i * base^(i - begin)
            up = np.full(len(self.hash) + 1, base, dtype=np.uint64)
            down = np.full(len(self.hash) + 1, pow(base, -1, 1 << 64), dtype=np.uint64)
            up[0] = down[0] = 1
            up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
            run = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(self.hash ^ np.uint64(seed)) * up[:-1], dtype=np.uint64)])
            out.append(mix((run[end] - run[at]) * down[at] + (end - at).astype(np.uint64)))
        return at, end - at, out[0], out[1]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(docs[text_col].isNotNull()).select(
        docs[id_col].alias("d"), F.shiftright(F.xxhash64(docs[text_col].cast("string")), 32).alias("t"),
        docs[text_col].cast("string").alias("text"))


def _span_hashes(rows: DataFrame, both_ends: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in text_ranges(batch.column(0)):
                yield pa.RecordBatch.from_arrays([_signed(Sentences(texts).spans(both_ends)[2])], names=["h"])

    return rows.select("text").mapInArrow(run, "h long")


def _span_places(rows: DataFrame, both_ends: bool) -> DataFrame:
    """(h, c, d, k, m): k holds the text's short hash above the number of the span's first
    sentence, m the number of sentences."""
    schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("c", T.LongType()),
                           T.StructField("d", rows.schema["d"].dataType), T.StructField("k", T.LongType()),
                           T.StructField("m", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.column(1).to_numpy()
            for a, _, texts in text_ranges(batch.column(2)):
                s = Sentences(texts)
                at, m, h, c = s.spans(both_ends)
                row = s.row[at] + a
                yield pa.RecordBatch.from_arrays(
                    [_signed(h), _signed(c), batch.column(0).take(pa.array(row)), pa.array((t[row] << 32) | s.pos[at]),
                     pa.array(m.astype(np.int32))],
                    names=["h", "c", "d", "k", "m"])

    return rows.mapInArrow(run, schema)


def repeated_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       both_ends: bool = False) -> DataFrame:
    """(d, t, gone): the later copies of spans, each the number of its first sentence above the
    number of its sentences."""
    rows = _texts(docs, id_col, text_col)
    often = _span_hashes(rows, both_ends).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("h").alias("_h"))
    often = stash(often, "span-hashes")
    places = _span_places(rows, both_ends)
    places = stash(places.join(often, F.col("h") == F.col("_h")).drop("_h"), "span-places")
    first = places.groupBy("h", "c").agg(F.min(F.struct("d", "k")).alias("first"))
    first = stash(first, "span-first").withColumnsRenamed({"h": "_h", "c": "_c"})
    later = places.join(first, (F.col("h") == F.col("_h")) & (F.col("c") == F.col("_c"))).where(
        ~F.struct("d", "k").eqNullSafe(F.col("first")))
    pos = F.col("k").bitwiseAND(F.lit((1 << 32) - 1))
    later = later.select("d", F.shiftright("k", 32).alias("t"), F.shiftleft(pos, 32).bitwiseOR(F.col("m").cast("long")).alias("run"))
    return later.distinct().groupBy("d", "t").agg(F.collect_list("run").alias("gone"))


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                counts: tuple[str, str] = ("n_sentences", "n_removed"), both_ends: bool = False) -> DataFrame:
    """``docs`` with the cleaned text, n_sentences and n_removed; every row and column is kept,
    but for columns of the names ``counts``, which are replaced.

    The first place of a span is the one in the row with the lowest key (nulls first, then by
    a hash of the text) and the lowest position. Words are compared without ASCII case and
    white space. Rows with the same key and text are one document and get the same result. A
    null text stays null; a text that loses nothing stays as it was; all else of a text stays
    byte for byte. Without ``both_ends`` only the spans that begin at each sentence are
    searched, and a later copy keeps the last sentences of a passage.
    """
    gone = repeated_sentences(docs, id_col, text_col, both_ends)
    d, t, g = (unused(c, docs.columns) for c in ("_d", "_t", "_gone"))
    keyed = docs.withColumn(t, F.shiftright(F.xxhash64(docs[text_col].cast("string")), 32))
    gone = gone.select(F.col("d").alias(d), F.col("t").alias(f"{t}_2"), F.col("gone").alias(g))
    cols = [c for c in docs.columns if c not in counts]
    j = keyed.join(gone, keyed[id_col].eqNullSafe(gone[d]) & (keyed[t] == gone[f"{t}_2"]), "left").select(
        *[F.col(c).cast("string").alias(c) if c == text_col else F.col(c) for c in cols], F.col(g))
    schema = T.StructType([*[j.schema[c] for c in cols], *[T.StructField(c, T.LongType()) for c in counts]])
    at_text = cols.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(len(cols))
            starts, flat = marks.offsets.to_numpy(), marks.values.to_numpy()
            null = marks.is_null().to_numpy(zero_copy_only=False)
            for a, b, texts in text_ranges(batch.column(at_text)):
                s = Sentences(texts)
                total, removed = np.bincount(s.row, minlength=b - a), np.zeros(b - a, dtype=np.int64)
                before = np.cumsum(total) - total
                for i in range(b - a):
                    if null[a + i] or texts[i] is None:
                        continue
                    runs = flat[starts[a + i]:starts[a + i + 1]]
                    begin, size = (runs >> 32) + before[i], runs & 0xFFFFFFFF
                    out = np.unique(np.concatenate([np.arange(x, x + m) for x, m in zip(begin, size)]))
                    removed[i] = len(out)
                    base = s.w.text_start[i]
                    left = np.ones(s.w.text_start[i + 1] - base - 1, dtype=bool)
                    for x in out:
                        left[s.begin[x] - base:s.stop[x] - base] = False
                    texts[i] = s.w.data[base:base + len(left)][left].tobytes().decode("utf-8", "replace")
                columns = [*(c.slice(a, b - a) for c in batch.columns[:len(cols)]), pa.array(total.astype(np.int64)), pa.array(removed)]
                columns[at_text] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return j.mapInArrow(run, schema)
