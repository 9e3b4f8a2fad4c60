"""Packing tokenised documents into sequences: vector bin packing by the dot-product heuristic.

An item is a piece of a document with three demands: tokens, segments (one each) and
loss-bearing tokens. One sequence is open at a time. Among the items that fit under all
three limits the one whose demand has the largest dot product with the sequence's
remaining capacities (both as shares of the limits) is placed, until none fits.

Items are numbered over all tasks and dealt by number to groups, and every group is packed by
itself: no group holds more than ``group_size`` items, however many of them are equal.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm.bpe import byte_alphabet
from foldwise.llm.common import stash, unused

SEQUENCE_TOKENS = 4096
MAX_SEGMENTS = 32
MAX_LOSS_TOKENS = 4080    # binds in sequences of few long segments, at the cost of 16 tokens of 4096 at most
GROUP_SIZE = 4096
KNOWN_PARTS = 350_000     # distinct parts whose ids a worker keeps
LATIN = "\u0100"
MARKS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"  # ASCII marks: without those that begin a contraction or a special token


def latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class ChunkEncoder:
    """Ids of whole texts through a tokenizer that drops case and white space between words.

    Such a tokenizer treats the parts between spaces independently, so the ids of a part are
    looked up where it was met before and texts are joined from their parts. New parts that are a
    Latin word, or one with marks behind it, skip the normaliser and the pre-tokenizer, which
    would leave the lower-cased word as it is: their words go to the model itself, many in one call.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.bare = Tokenizer(self.tok.model)
        vocab = self.tok.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, dtype=bool)  # ids that end a word
        suffix = self.tok.model.end_of_word_suffix
        self.last[[i for token, i in vocab.items() if suffix and token.endswith(suffix)]] = True
        alphabet = byte_alphabet()
        self.as_bytes = {n: "".join(alphabet[b] for b in chr(n).encode()) for n in range(128, 256)}
        self.end = array("I", [end_id]).tobytes()
        self.known: dict[str, bytes] = {"": b""}
        self.missed = 0

    def _encode(self, parts: list[str]) -> dict[str, bytes]:
        out = {}
        for at in range(0, len(parts), 20_000):
            some = parts[at:at + 20_000]
            got = self.tok.encode_batch_fast(some, add_special_tokens=False)
            out.update([(c, array("I", e.ids).tobytes()) for c, e in zip(some, got)])
        return out

    def _encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of lower-case Latin words: the ids of many, cut behind those that end a word."""
        out = {}
        for at in range(0, len(words), 5_000):
            some = words[at:at + 5_000]
            pieces = "\n".join(some).translate(self.as_bytes).split("\n")
            got = self.bare.encode_batch_fast([pieces], is_pretokenized=True, add_special_tokens=False)[0]
            ids = np.array(got.ids, dtype=np.uint32)
            ends = ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()
            if len(ends) != len(some):  # a vocabulary that does not mark the ends of words
                out.update(self._encode(some))
                continue
            raw = ids.tobytes()
            out.update(zip(some, [raw[a:b] for a, b in zip([0, *ends], ends)]))
        return out

    def _learn(self, parts: set[str]) -> dict[str, bytes]:
        """Ids of parts not met before. A Latin word and the marks behind it are separate pieces."""
        known = self.known
        split, plain = {}, set()
        for c in parts:
            word = c.rstrip(MARKS)
            if word.isalpha() and (word.isascii() or max(word) < LATIN):
                split[c] = word.lower(), c[len(word):]
            else:
                plain.add(c)
        plain.update([m for _, m in split.values() if m not in known])
        got = self._encode(list(plain))
        got.update(self._encode_words(list({w for w, _ in split.values() if w not in known})))
        look = {x: known[x] for pair in split.values() for x in pair if x in known} | got
        got.update([(c, look[w] + look[m]) for c, (w, m) in split.items()])
        return got

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        known = self.known
        if self.missed > 8 * KNOWN_PARTS:  # the texts have changed: learn anew
            known.clear()
            known[""] = b""
            self.missed = 0
        rows: list[list[bytes | None]] = []
        open_ = []  # row, place and part where a part was not met before
        get = known.get
        for t in texts:
            t = (t or "").replace("\n", " ")
            if t.isascii() or latin(t):
                t = t.lower()
            cut = t.split(" ")
            row = list(map(get, cut))
            rows.append(row)
            at = -1
            for _ in range(row.count(None)):
                at = row.index(None, at + 1)
                open_.append((row, at, cut[at]))
        if open_:
            new = self._learn({c for _, _, c in open_})
            self.missed += len(new)
            for row, at, c in open_:
                row[at] = new[c]
            if len(known) < KNOWN_PARTS:
                known.update(new)
        return [b"".join(row) + self.end for row in rows]


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int) -> ChunkEncoder:
    """One per Python worker, so later tasks of the worker find the parts already met."""
    return ChunkEncoder(path, end_id)


def tokenise(docs: DataFrame, tokenizer_path: str, end_id: int, max_tokens: int = SEQUENCE_TOKENS,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``max_tokens`` ids: (id, start, length, doc_tokens, ids_le binary).

    A null text is empty; every document ends with ``end_id``, so it has a piece at least.
    """
    schema = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("doc_tokens", T.LongType()),
        T.StructField("ids_le", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, end_id)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows: list[tuple[int, int, int, bytes]] = []
                for i, ids in enumerate(encode(part.column(1).to_pylist())):
                    total = len(ids) // 4
                    for s in range(0, total, max_tokens):
                        rows.append((i, s, total, ids[4 * s:4 * (s + max_tokens)]))
                who, start, total, ids = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(who)), pa.array(start, pa.int64()),
                     pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(total, pa.int64()),
                     pa.array(ids, pa.binary())], names=[f.name for f in schema.fields])

    out = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)


def pack_items(demand: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, order in it) of every item; ``demand`` is items x dimensions, none above its limit.

    Items of equal demand are interchangeable, so the search runs over distinct demands.
    """
    kinds, kind_of = np.unique(demand, axis=0, return_inverse=True)
    kind_of = kind_of.ravel()
    members = np.argsort(kind_of, kind="stable")
    left = np.bincount(kind_of, minlength=len(kinds))
    first = np.concatenate([[0], np.cumsum(left)[:-1]])
    taken = np.zeros(len(kinds), dtype=np.int64)
    share = kinds / limits
    seq, order = np.zeros(len(demand), dtype=np.int64), np.zeros(len(demand), dtype=np.int64)
    todo, s = len(demand), 0
    while todo:
        room, n = limits.astype(np.int64).copy(), 0
        while todo:
            fits = (kinds <= room).all(axis=1) & (left > 0)
            if not fits.any():
                break
            score = np.where(fits, share @ (room / limits), -1.0)
            k = int(score.argmax())
            item = members[first[k] + taken[k]]
            taken[k] += 1
            left[k] -= 1
            seq[item], order[item] = s, n
            room -= kinds[k]
            n += 1
            todo -= 1
        s += 1
        if todo and s % 64 == 0:  # drop demands that are used up
            keep = left > 0
            kinds, share, left, first, taken = kinds[keep], share[keep], left[keep], first[keep], taken[keep]
    return seq, order


def pack(pieces: DataFrame, length_col: str = "length", loss_col: str | None = None,
         max_tokens: int = SEQUENCE_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS_TOKENS,
         group_size: int = GROUP_SIZE, seed: int = 11) -> DataFrame:
    """Every row of ``pieces`` with its ``sequence_id`` and ``offset`` (gapless from 0).

    ``loss_col`` names the loss-bearing tokens of a piece; without it every token but the
    first counts. Rows are kept one by one, also repeated ones. A null or negative length
    counts as 0; a piece above a limit raises an error.
    """
    cols = pieces.columns
    length = F.greatest(F.coalesce(F.col(length_col).cast("long"), F.lit(0)), F.lit(0))
    loss = F.greatest(F.coalesce(F.col(loss_col).cast("long"), F.lit(0)), F.lit(0)) if loss_col else \
        F.greatest(length - 1, F.lit(0))
    row, place, group, len_, loss_ = (unused(c, cols) for c in ("_row", "_place", "_group", "_len", "_loss"))
    # the numbers are written with the rows: whoever reads them again finds the same ones
    kept = stash(pieces.withColumns({len_: length, loss_: loss, row: F.monotonically_increasing_id()}), "numbered")
    task = F.shiftright(row, 33)
    sizes = kept.groupBy(task.alias(place)).agg(F.count(F.lit(1)).alias(group)).collect()  # a row per task that wrote
    before, total = {}, 0
    for r in sorted(sizes):
        before[r[0]], total = total, total + r[1]
    groups = max(1, -(-total // group_size))
    offsets = pieces.sparkSession.createDataFrame([(k, v) for k, v in before.items()], f"{place} long, {group} long")
    dealt = kept.withColumn(place, task).join(F.broadcast(offsets), place)
    number = F.col(group) + F.col(row).bitwiseAND(F.lit((1 << 33) - 1))
    dealt = dealt.withColumn(group, F.pmod(number, F.lit(groups))).drop(place, row)
    limits = np.array([max_tokens, max_segments, max_loss])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        demand = np.stack([pdf[len_].to_numpy(), np.ones(len(pdf), dtype=np.int64), pdf[loss_].to_numpy()], axis=1)
        if (demand > limits).any():
            raise ValueError(f"a piece is above the limits {limits.tolist()}")
        seq, order = pack_items(demand, limits)
        at = np.lexsort((order, seq))
        size = demand[at, 0]
        begin = np.cumsum(size) - size
        new = np.concatenate([[True], seq[at][1:] != seq[at][:-1]])
        base = np.maximum.accumulate(np.where(new, begin, 0))
        offset = np.empty(len(pdf), dtype=np.int64)
        offset[at] = begin - base
        out = pdf[cols].copy()
        out["sequence_id"] = pdf[group].to_numpy() * (1 << 24) + seq
        out["offset"] = offset
        return out

    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])
    return dealt.groupBy(group).applyInPandas(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Pieces of all documents with ids, crc32 of the ids, sequence and offset.

    The token ids stay with the pieces only until their checksum is taken; what is
    shuffled and packed are rows of a few numbers.
    """
    # a piece's first token bears no loss
    pieces = tokenise(docs, tokenizer_path, end_id, min(SEQUENCE_TOKENS, MAX_LOSS_TOKENS + 1), id_col, text_col)
    return pack(pieces.select(id_col, "start", "length", F.crc32("ids_le").alias("ids_crc32"), "doc_tokens"))
