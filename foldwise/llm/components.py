"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import discard, stash


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every neighbour above u is linked to the smallest of u and its neighbours; the table of these."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m"))
    low = stash(low.select(F.col("a").alias("u"), F.least("a", "m").alias("m")), "star-low")
    out = both.join(low, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct(), low


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every smaller neighbour of u, and u itself, are linked to the smallest of them; the table of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = stash(down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u"), "star-low")
    out = down.join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = low.select(F.col("u").alias("a"), F.col("m").alias("b"))
    return out.unionByName(own).where("a <> b").distinct(), low


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link; the component is its smallest node.

    ``edges`` has the columns a and b of one orderable type. Loops and repeated links do no
    harm. The steps end when the table no longer changes, after about the logarithm of the
    longest path; only two sums come to the driver.
    """
    now = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                "links")

    def state(df: DataFrame):
        h = F.xxhash64("a", "b")
        return tuple(df.agg(F.count(F.lit(1)), F.sum(h.bitwiseAND(F.lit((1 << 40) - 1))), F.bit_xor(h)).first())

    seen = state(now)
    while True:
        out, low = _large_star(now)
        large = stash(out, "large-star")
        discard(low, now)
        out, low = _small_star(large)
        now = stash(out, "small-star")
        discard(low, large)
        new = state(now)
        if new == seen:
            break
        seen = new
    root = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(root)
