"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a run of bytes other than ASCII white space (\\x20, \\x09-\\x0D). Its hash is a
polynomial over random 64-bit byte values, computed for all words together and mixed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_VALUE = np.random.default_rng(20).integers(1, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int) -> np.ndarray:
    return _powers(1 << max(8, int(n - 1).bit_length()))


def run_hash(values: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Hash of each run ``values[start:start + len]``; runs are consecutive and cover all values."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    at = np.arange(len(values)) - np.repeat(starts, lens)
    return mix(np.add.reduceat(values * powers(int(lens.max()))[at], starts) + lens.astype(np.uint64))


class Words:
    """Words of ``texts`` in order: row of the text, byte range in ``data``, hash."""

    def __init__(self, texts: Sequence[str | None]):
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        sizes = np.array([len(r) for r in raw], dtype=np.int64)
        self.data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
        self.text_start = np.concatenate([[0], np.cumsum(sizes + 1)])  # one line end follows each text
        inside = ~_SPACE[self.data]
        edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.row = np.searchsorted(self.text_start, self.start, side="right") - 1
        lens = self.end - self.start
        letters = _VALUE[_LOWER[self.data[inside]]]
        self.hash = run_hash(letters, np.cumsum(lens) - lens, lens)
        self.n_texts = len(raw)

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.n_texts)


def text_ranges(column: pa.Array, max_bytes: int = 400_000) -> Iterator[tuple[int, int, list[str | None]]]:
    """(begin, end, texts) of consecutive rows that together have about ``max_bytes`` (one row at
    least); only these texts are held as Python strings at a time."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy()
    at = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > at and total + n > max_bytes:
            yield at, i, column.slice(at, i - at).to_pylist()
            at, total = i, 0
        total += n + 1
    if at < len(sizes):
        yield at, len(sizes), column.slice(at).to_pylist()
