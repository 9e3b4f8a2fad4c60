"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.session import scratch_path


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and return the table read back.

    Used where several later steps read an intermediate table: the lineage is cut,
    the files survive lost executors, and the re-read side is a plain scan, so a join
    on it gets an exchange of its own that AQE can split when a key is hot.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def discard(*spent: DataFrame) -> None:
    """Delete the files of tables of ``stash`` whose successors are written and that nothing reads any more."""
    for df in spent:
        spark = df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(df.stash_path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def text_crc(col: str) -> Column:
    """crc32 of a key written as text (a null key counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def slices(texts: Iterable[str | None], max_chars: int = 1_000_000) -> Iterator[list[tuple[int, str]]]:
    """Batches of (row, piece) of at most ``max_chars`` characters; long texts are cut into
    several pieces, short ones are grouped, so vectorised code has bounded memory."""
    batch: list[tuple[int, str]] = []
    size = 0
    for i, t in enumerate(texts):
        t = t or ""
        for at in range(0, max(len(t), 1), max_chars):
            piece = t[at:at + max_chars]
            if batch and size + len(piece) > max_chars:
                yield batch
                batch, size = [], 0
            batch.append((i, piece))
            size += len(piece)
    if batch:
        yield batch


def unused(name: str, columns: Iterable[str]) -> str:
    """``name``, with underscores before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def chunks_of_groups(start: np.ndarray, size: np.ndarray, most: int):
    """Runs of groups with about ``most`` pairs."""
    if not len(start):
        return
    part = np.cumsum(size * (size - 1) // 2) // most
    edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
    for a, b in zip(edge[:-1], edge[1:]):
        yield start[a:b], size[a:b]


def pairs_of_groups(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs x < y within each group."""
    row = np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    left = np.repeat(start + size, size) - row - 1  # later members of the group
    x = np.repeat(row, left)
    return x, x + 1 + np.arange(left.sum()) - np.repeat(np.cumsum(left) - left, left)
