"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Every piece of a text (pre-tokenizer piece, as bytes) has a segment tree whose leaf i
holds ``rank(pair at i) * 2^20 + i``. The root is then the leftmost pair of the lowest
rank. Merging it changes three leaves (the merged pair, its right part, its left
neighbour), each a point update of log2(n) nodes; the piece is done when the root is
empty. Short pieces run together, one numpy column per piece and one merge of every
unfinished piece per step; long pieces run alone on Python lists.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed value: the split pattern of the byte-level pre-tokenizer.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_PAIR = np.int64(1 << 62)
POS_BITS = 20
LONG_PIECE = 256          # bytes; longer pieces use the scalar tree
KNOWN_CHUNKS = 500_000    # distinct chunks whose ids a worker keeps


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable
    Latin-1, else the next free code point from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = {b: chr(b) for b in own}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return [out[b] for b in range(256)]


class ByteBPE:
    """A byte-level BPE vocabulary read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        alphabet = byte_alphabet()
        of_char = {c: b for b, c in enumerate(alphabet)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.size = size
        self.byte_id = np.array([vocab[c] for c in alphabet], dtype=np.int64)
        self.token_bytes = [b""] * size
        for tok, i in vocab.items():
            self.token_bytes[i] = bytes(of_char[c] for c in tok if c in of_char)
        for tok, i in self.special.items():
            self.token_bytes[i] = tok.encode()
        rows = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] * (size + 1) + vocab[b] for a, b in rows], dtype=np.int64)
        new = np.array([vocab[a + b] for a, b in rows], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.new = keys[order], order.astype(np.int64), new[order]
        self.pairs = {int(k): (int(r), int(n)) for k, r, n in zip(self.keys, self.rank, self.new)}
        self.pattern = regex.compile(SPLIT)
        from tokenizers import Tokenizer

        self.pre_tokenizer = Tokenizer.from_file(path).pre_tokenizer
        self.known: dict[str, bytes] = {}
        self.missed = 0
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) \
            if self.special else None

    # ------------------------------------------------------------ merging
    def _leaf(self, left: np.ndarray, right: np.ndarray, pos: np.ndarray) -> np.ndarray:
        key = left * (self.size + 1) + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, (self.rank[at] << POS_BITS) | pos, NO_PAIR)

    def _merge_short(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Segment trees of all ``pieces`` (at most ``width`` bytes, a power of two) side by side."""
        n = len(pieces)
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(n, width).T
        lens = np.array([len(p) for p in pieces])
        row = np.arange(width)[:, None]
        tok = np.full((width + 1, n), self.size, dtype=np.int64)  # row ``width``: the end, pairs with nothing
        tok[:width] = np.where(row < lens, self.byte_id[flat], self.size)
        nxt = np.where(row + 1 < lens, row + 1, width)
        prv = np.broadcast_to(row - 1, (width, n)).copy()
        tree = np.full((2 * width, n), NO_PAIR, dtype=np.int64)
        tree[width:] = self._leaf(tok[:-1].ravel(), tok[1:].ravel(),
                                  np.broadcast_to(row, (width, n)).ravel()).reshape(width, n)
        level = width
        while level > 1:
            half = level // 2
            tree[half:level] = np.minimum(tree[level:2 * level:2], tree[level + 1:2 * level:2])
            level = half
        live = np.arange(n)
        while True:
            root = tree[1, live]
            live = live[root < NO_PAIR]
            if not live.size:
                break
            p = tree[1, live] & ((1 << POS_BITS) - 1)
            q = nxt[p, live]
            key = tok[p, live] * (self.size + 1) + tok[q, live]
            tok[p, live] = self.new[np.searchsorted(self.keys, key)]
            after = nxt[q, live]
            nxt[p, live] = after
            tok[q, live] = self.size
            has = after < width
            prv[after[has], live[has]] = p[has]
            before = prv[p, live]
            tree[width + q, live] = NO_PAIR
            tree[width + p, live] = self._leaf(tok[p, live], tok[after, live], p)
            has = before >= 0
            b, cols = before[has], live[has]
            tree[width + b, cols] = self._leaf(tok[b, cols], tok[p[has], cols], b)
            for leaf, at in ((q, live), (p, live), (b, cols)):
                node = (width + leaf) >> 1
                while node.size and node[0] >= 1:
                    tree[node, at] = np.minimum(tree[2 * node, at], tree[2 * node + 1, at])
                    node = node >> 1
        out = tok[:width].T
        return [t[t < self.size].astype("<u4").tobytes() for t in out]

    def _merge_long(self, piece: bytes) -> bytes:
        width = 1 << max(1, (len(piece) - 1).bit_length())
        none = 1 << 62
        tok = [int(x) for x in self.byte_id[np.frombuffer(piece, dtype=np.uint8)]]
        n = len(tok)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * width)
        bits = width.bit_length()

        def leaf(i: int) -> int:
            j = nxt[i]
            hit = self.pairs.get(tok[i] * (self.size + 1) + tok[j]) if j < n else None
            return hit[0] << bits | i if hit else none

        def update(i: int, v: int) -> None:
            at = width + i
            tree[at] = v
            at >>= 1
            while at:
                v = min(tree[2 * at], tree[2 * at + 1])
                if tree[at] == v:
                    break
                tree[at] = v
                at >>= 1

        for i in range(n):
            tree[width + i] = leaf(i)
        for at in range(width - 1, 0, -1):
            tree[at] = min(tree[2 * at], tree[2 * at + 1])
        while tree[1] < none:
            p = tree[1] & ((1 << bits) - 1)
            q = nxt[p]
            tok[p] = self.pairs[tok[p] * (self.size + 1) + tok[q]][1]
            tok[q] = -1
            nxt[p] = nxt[q]
            if nxt[q] < n:
                prv[nxt[q]] = p
            update(q, none)
            update(p, leaf(p))
            if prv[p] >= 0:
                update(prv[p], leaf(prv[p]))
        return np.array([t for t in tok if t >= 0], dtype="<u4").tobytes()

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each piece."""
        out: list[bytes] = [b""] * len(pieces)
        groups: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if len(p) > LONG_PIECE:
                out[i] = self._merge_long(p)
            elif p:
                groups.setdefault(max(4, 1 << (len(p) - 1).bit_length()), []).append(i)
        for width, rows in groups.items():
            step = max(1, (1 << 19) // width)
            for at in range(0, len(rows), step):
                part = rows[at:at + step]
                for i, ids in zip(part, self._merge_short([pieces[i] for i in part], width)):
                    out[i] = ids
        return out

    # ------------------------------------------------------------ texts
    def pieces(self, text: str) -> list[str]:
        """Pre-tokenizer pieces. Letters and digits beyond Latin depend on the Unicode version,
        so texts that hold any are cut by the tokenizer's own pre-tokenizer."""
        if text.isascii() or max(text) < "\u0250":
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.pre_tokenizer.pre_tokenize_str(text)]

    def _chunks(self, text: str) -> list[str]:
        """Chunks whose encodings are independent: cut before each single space that has a
        word on its right. Texts with runs or ends of spaces are cut by the full pattern."""
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return self.pieces(text)
        parts = text.split(" ")
        return [parts[0], *[f" {p}" for p in parts[1:]]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut: list[list[str]] = []
        for t in texts:
            if not t:
                cut.append([])
            elif self.specials is not None and self.specials.search(t):
                row: list[str] = []
                at = 0
                for m in self.specials.finditer(t):
                    row += self._chunks(t[at:m.start()]) if m.start() > at else []
                    row.append(m.group())
                    at = m.end()
                cut.append(row + (self._chunks(t[at:]) if at < len(t) else []))
            else:
                cut.append(self._chunks(t))
        if self.missed > 8 * KNOWN_CHUNKS:  # the texts have changed: learn anew
            self.known, self.missed = {}, 0
        known = self.known
        fresh = list(set().union(*cut).difference(known))
        split = [[c] if c in self.special else self.pieces(c) for c in fresh]
        words = list({p for row in split for p in row if p not in self.special})
        ids = dict(zip(words, self.merge([p.encode() for p in words])))
        ids.update((s, np.array([i], dtype="<u4").tobytes()) for s, i in self.special.items())
        new = dict(zip(fresh, [b"".join([ids[p] for p in row]) for row in split]))
        self.missed += len(new)
        if len(known) < KNOWN_CHUNKS:
            known.update(new)
        get = known.get
        return [b"".join([x if (x := get(c)) is not None else new[c] for c in row]) for row in cut]

    def decode(self, ids: bytes) -> str:
        """Text of little-endian 32-bit ids; bytes that are no UTF-8 become U+FFFD."""
        names = self.token_bytes
        return b"".join([names[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> ByteBPE:
    """One per Python worker, so later tasks of the worker find the chunks already met."""
    return ByteBPE(path)


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids_le binary, decoded string) of every row.

    ``ids_le`` are the ids as little-endian unsigned 32-bit integers. A null or empty text
    has no ids and decodes to the empty text; repeated rows and ties are kept one by one;
    other columns are not carried. ``tokenizer_path`` must be readable on the executors.
    """
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = bpe.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.string())],
                    names=["id", "ids_le", "decoded"])

    schema = T.StructType([T.StructField("id", id_type), T.StructField("ids_le", T.BinaryType()),
                           T.StructField("decoded", T.StringType())])
    out = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)
