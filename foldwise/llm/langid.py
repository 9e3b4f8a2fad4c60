"""Language identification by cross-parsing with suffix automata.

For every language a suffix automaton is built over sampled labelled text. A text is
parsed from left to right into the longest phrases that occur in that text; the number
of phrases c of a text of m characters against n training characters estimates the
cross entropy c * log2(n) / m, and the language with the lowest value wins.

The automaton is laid out as a table: one row per state, one column per letter class,
the entry is ``next state * 2 + (1 if a new phrase begins with this character)``, so a parse
is one table look-up per character. Texts are parsed in blocks of ``BLOCK`` characters,
each from the start state, many blocks side by side; whole texts are read.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm.common import slices

SAMPLE_DOCS = 600      # labelled documents sampled per language, in expectation
SLICE_CHARS = 120      # characters taken of each, from a place that its key decides
TRAIN_CHARS = 24_000   # training characters kept per language at most
LETTERS = 60           # most frequent letters with a class of their own
BLOCK = 512
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """1 for every code point that is a letter, else 0."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            out[c] = 1
    return out


class SuffixAutomaton:
    """Smallest automaton of all substrings of ``codes`` (small integers)."""

    def __init__(self, codes: Sequence[int]):
        self.next: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        last = 0
        for c in codes:
            cur = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur

    def table(self, n_codes: int) -> np.ndarray:
        """Flat look-up table; a missing transition starts a new phrase with this character.
        State 0 stands between phrases: a parse begins there, and a character that the training
        text lacks is a phrase of its own and leads back to it."""
        start = np.zeros(n_codes, dtype=np.int32)
        for c, to in self.next[0].items():
            start[c] = to
        out = np.tile(start * 2 + 1, (len(self.next), 1))
        for s, moves in enumerate(self.next[1:], 1):
            for c, to in moves.items():
                out[s, c] = to * 2
        return out.astype(np.int32).ravel()


@dataclass
class LanguageModel:
    langs: list[str]
    classes: np.ndarray       # class of each code point: 0 no letter, 1 a rare letter, 2.. frequent letters
    n_codes: int              # classes and the padding class
    tables: list[np.ndarray]
    bits: list[float]         # log2 of the training characters of each language

    def phrases(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrases per text and language, characters parsed, letters) of whole texts."""
        n = len(texts)
        count = np.zeros((n, len(self.langs)))
        chars, letters = np.zeros(n), np.zeros(n)
        pad = self.n_codes - 1
        for batch in slices(texts):
            codes, owner = [], []
            for row, piece in batch:
                c = self.classes[np.frombuffer(piece.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
                keep = np.ones(len(c), dtype=bool)  # one separator for a run of non-letters
                keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
                c = c[keep]
                chars[row] += len(c)
                letters[row] += np.count_nonzero(c)
                blocks = -(-len(c) // BLOCK)
                codes.append(np.concatenate([c, np.full(blocks * BLOCK - len(c), pad, dtype=np.uint8)]))
                owner.append(np.full(blocks, row))
            grid = np.concatenate(codes).reshape(-1, BLOCK)
            owner = np.concatenate(owner)
            order = np.argsort((grid == pad).sum(axis=1), kind="stable")  # longest first
            grid, owner = grid[order].T.astype(np.int64), owner[order]
            live = (grid != pad).sum(axis=1)
            for k, moves in enumerate(self.tables):
                state = np.zeros(grid.shape[1], dtype=np.int64)
                found = np.zeros(grid.shape[1], dtype=np.int64)
                for t in range(BLOCK):
                    m = live[t]
                    if not m:
                        break
                    e = moves[state[:m] * self.n_codes + grid[t, :m]]
                    found[:m] += e & 1
                    state[:m] = e >> 1
                np.add.at(count[:, k], owner, found)
        return count, chars, letters

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: 1 - (lowest / second lowest cross entropy)."""
        count, chars, letters = self.phrases(texts)
        h = np.maximum(count, 1) * np.array(self.bits) / np.maximum(chars, 1)[:, None]
        best = h.argmin(axis=1)
        low = np.sort(h, axis=1)
        score = 1 - low[:, 0] / low[:, 1] if h.shape[1] > 1 else np.ones(len(texts))
        none = letters == 0
        score = np.where(none, 0.0, np.clip(score, 0, 1))
        return [UNDETERMINED if u else self.langs[b] for b, u in zip(best, none)], score


def learn(train: dict[str, list[str]]) -> LanguageModel | None:
    """Automata of the labelled texts; None where there are none."""
    joined = {k: " ".join(v).lower()[:TRAIN_CHARS] for k, v in sorted(train.items())}
    is_letter = letter_table()
    seen = Counter(c for t in joined.values() for c in t if is_letter[ord(c)])
    if not seen:
        return None
    classes = is_letter.copy()
    for i, (c, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:LETTERS]):
        classes[ord(c)] = 2 + i
    n_codes = min(LETTERS, len(seen)) + 3
    langs, tables, bits = [], [], []
    for lang, t in joined.items():
        codes = classes[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        codes = codes[np.r_[True, (codes[1:] != 0) | (codes[:-1] != 0)]] if len(codes) else codes
        if np.count_nonzero(codes):
            langs.append(lang)
            tables.append(SuffixAutomaton(codes.tolist()).table(n_codes))
            bits.append(math.log2(max(2, len(codes))))
    return LanguageModel(langs, classes, n_codes, tables, bits)


def fit(docs: DataFrame, trainable: Column, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang", max_langs: int = 1000) -> LanguageModel | None:
    """Learn from a bounded sample: of each language about ``SAMPLE_DOCS`` rows chosen by a
    hash of the key, and ``SLICE_CHARS`` characters of each. Rows with a null language or no
    text teach nothing. More than ``max_langs`` languages raise an error.
    """
    rows = docs.where(trainable & F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    counts = rows.groupBy(lang_col).count().limit(max_langs + 1).collect()
    if len(counts) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    if not counts:
        return None
    h = F.pmod(F.xxhash64(F.col(id_col), F.lit(5)), F.lit(1 << 30))
    share = F.coalesce(*[F.when(F.col(lang_col) == r[0], F.lit(min(1.0, SAMPLE_DOCS / r[1]))) for r in counts])
    at = F.pmod(F.xxhash64(F.col(id_col), F.lit(6)), F.greatest(F.length(text_col) - SLICE_CHARS, F.lit(1))) + 1
    sample = rows.where(h < share * (1 << 30)).select(
        F.col(lang_col).alias("lang"), F.substring(F.col(text_col), at.cast("int"), F.lit(SLICE_CHARS)).alias("t"), h.alias("h"))
    got: dict[str, list[str]] = {}
    for r in sorted(sample.collect(), key=lambda r: (r.lang, r.h, r.t)):
        got.setdefault(r.lang, []).append(r.t)
    return learn(got)


def identify(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row; ``und`` with score 0 for a null text, a text
    without a letter, or when nothing was learned. Repeated rows are kept one by one."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                texts = part.column(1).to_pylist()
                lang, score = m.predict(texts) if m else ([UNDETERMINED] * len(texts), np.zeros(len(texts)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                                 names=["id", "lang_pred", "score"])

    out = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)
