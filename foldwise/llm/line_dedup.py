"""Line dedup: repeated runs of lines found by a suffix array over line ids.

Every document is a sequence of line ids. The suffix array of all sequences is built by
distributed prefix doubling: the rank of a position orders its next h lines; the ranks of
positions i and i + (h' - h) order the next h' lines. Ranks are refined within their class
(a suffix keeps its rank plus the number of suffixes of its class that now precede it), and
a position whose next h lines occur nowhere else leaves, so only repeated runs are carried.

After each step the suffixes of one rank are contiguous in the suffix array and share a
prefix of h lines: they are the longest-common-prefix interval of depth h. From depth
``min_lines`` on, every member of an interval but the first in document order starts a
later copy of h lines, and its lines are deleted. A maximal repeated run of l lines,
h <= l < 2h, is covered by its first and its last h lines, so the steps h = min_lines,
2 min_lines, 4 min_lines, ... together delete whole maximal runs. Shorter runs count when they
are long texts: at every depth below ``min_lines`` the intervals of runs of ``min_words`` words or
more are taken too.

DataFrame operations only. Classes of any size are counted by map-side combined aggregates;
the joins back to the positions have plain scans on both sides, so AQE splits a hot line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldwise.llm.common import stash, unused
from foldwise.operators.rank import prefix_sums

MIN_LINES = 3
MIN_WORDS = 50  # words from which a run of fewer lines counts too
SPACE = "[\\x20\\x09-\\x0D]+"
RANK_BUCKETS = 4096


def _depths(min_lines: int, each: bool = False):
    """1, 2, 4, ... up to min_lines (``each``: every length up to it), then min_lines doubled on and on."""
    h = 1
    while True:
        yield h
        h = (h + 1 if each else min(2 * h, min_lines)) if h < min_lines else 2 * h


def _key(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """A document is its key and the hash of its text; repeated rows are one document."""
    return [docs[id_col].alias("d"), F.xxhash64(docs[text_col].cast("string")).alias("t")]


def line_ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, t, pos, a, b, words): two 64-bit hashes identify a line."""
    lines = docs.where(docs[text_col].isNotNull()).select(
        *_key(docs, id_col, text_col), F.posexplode(F.split(docs[text_col].cast("string"), "\n")).alias("pos", "line"))
    words = F.size(F.filter(F.split("line", SPACE), lambda w: w != ""))
    return lines.select("d", "t", "pos", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(77), "line").alias("b"),
                        words.alias("words"))


def _ranked(classes: DataFrame, bucket: Column, order: list[str], within: list[str]) -> DataFrame:
    """``classes`` with ``before_n``: members of the classes that precede, in order, within ``within``."""
    return prefix_sums(classes.withColumn("_bucket", bucket), ["n"], ["_bucket"], order, within).drop("_bucket")


def suffix_intervals(docs: DataFrame, min_lines: int = MIN_LINES, id_col: str = "doc_id", text_col: str = "text",
                     min_words: int | None = None):
    """Yields (h, members) for the depths from ``min_lines`` on that have an interval, and with
    ``min_words`` for the lower ones, there only intervals of runs of so many words.

    ``members`` has (d, t, pos, rank, n, first): the rank is the interval's place in the
    suffix array of repeated runs, n its size, first whether this is its first occurrence.
    """
    lines = line_ids(docs, id_col, text_col)
    classes = stash(lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "line-counts")
    # the order of line ids is the order of their hashes; buckets of the leading bits keep it
    classes = _ranked(classes, F.shiftright("a", 52), ["a", "b"], []).select(
        F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("before_n").alias("rank"))
    classes = stash(classes, "line-classes")
    state = stash(lines.join(classes, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")))
                  .select("d", "t", "pos", "rank", *([] if min_words is None else ["words", F.col("words").alias("run_words")])),
                  "suffixes")
    per_bucket = max(1, state.count() // RANK_BUCKETS)
    h = 1
    for target in _depths(min_lines, min_words is not None):
        if target > h:
            by_doc = W.partitionBy("d", "t").orderBy("pos").rangeBetween(target - h, target - h)
            # below min_lines a run grows by one line: its words are the line's and those of the run after it
            more = ["words", "run_words"] if min_words is not None and target < min_lines else []
            pairs = state.select("d", "t", "pos", "rank", F.max("rank").over(by_doc).alias("second"), *[
                "words" if c == "words" else (F.col("words") + F.max(c).over(by_doc)).alias(c) for c in more])
            pairs = pairs.where(F.col("second").isNotNull())
            pairs = stash(pairs, "suffix-pairs")
            classes = stash(pairs.groupBy("rank", "second").agg(F.count(F.lit(1)).alias("n")).where("n > 1"),
                            "pair-counts")
            classes = _ranked(classes, F.floor(F.col("second") / per_bucket), ["second"], ["rank"]).select(
                F.col("rank").alias("_r"), F.col("second").alias("_s"), (F.col("rank") + F.col("before_n")).alias("finer"))
            classes = stash(classes, "suffix-classes")
            state = stash(pairs.join(classes, (F.col("rank") == F.col("_r")) & (F.col("second") == F.col("_s")))
                          .select("d", "t", "pos", F.col("finer").alias("rank"), *more), "suffixes")
            h = target
        if state.isEmpty():
            return
        if h >= min_lines:
            yield h, state
        elif min_words is not None:
            yield h, state.where(F.col("run_words") >= min_words)


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, id_col: str = "doc_id",
                  text_col: str = "text", min_words: int | None = MIN_WORDS) -> DataFrame:
    """(d, t, runs): for documents with later copies, the maximal runs of lines to delete as
    an array of (gap, len), gap counted from the end of the run before."""
    copies = None
    for h, state in suffix_intervals(docs, min_lines, id_col, text_col, min_words):
        first = stash(state.groupBy("rank").agg(F.min(F.struct("d", "t", "pos")).alias("first")), "interval-first")
        first = first.withColumnRenamed("rank", "_r")
        later = state.join(first, F.col("rank") == F.col("_r")).where(
            ~F.struct("d", "t", "pos").eqNullSafe(F.col("first")))
        later = later.select("d", "t", "pos", (F.col("pos") + h).alias("end"))
        copies = later if copies is None else copies.unionByName(later)
    if copies is None:
        return line_ids(docs, id_col, text_col).where(F.lit(False)).select(
            "d", "t", F.array().cast("array<struct<gap:int,len:int>>").alias("runs"))
    by_doc = W.partitionBy("d", "t").orderBy("pos")
    ends = copies.groupBy("d", "t", "pos").agg(F.max("end").alias("end"))
    reach = F.max("end").over(by_doc.rowsBetween(W.unboundedPreceding, -1))
    ends = ends.withColumn("new", F.coalesce((F.col("pos") > reach).cast("int"), F.lit(1)))
    ends = ends.withColumn("run", F.sum("new").over(by_doc))
    runs = ends.groupBy("d", "t", "run").agg(F.min("pos").alias("pos"), F.max("end").alias("end"))
    gap = F.col("pos") - F.coalesce(F.lag("end").over(by_doc), F.lit(0))
    runs = runs.select("d", "t", "pos", F.struct(gap.alias("gap"), (F.col("end") - F.col("pos")).alias("len")).alias("r"))
    return runs.groupBy("d", "t").agg(F.array_sort(F.collect_list(F.struct("pos", "r"))).alias("x")).select(
        "d", "t", F.transform("x", lambda x: x["r"]).cast("array<struct<gap:int,len:int>>").alias("runs"))


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, id_col: str = "doc_id", text_col: str = "text",
                counts: tuple[str, str] = ("n_lines", "n_removed"), min_words: int | None = MIN_WORDS) -> DataFrame:
    """``docs`` with the cleaned text, n_lines and n_removed; every row and column is kept, but
    for columns of the names ``counts``, which are replaced.

    A line goes when it lies in a run of at least ``min_lines`` lines, or of fewer lines with together
    at least ``min_words`` words (None: no such runs), that also starts at an earlier place (documents in the order of their key, nulls first, then the hash of the text).
    Lines are compared exactly, blank ones too. Rows with the same key and text are one
    document and get the same result. A null text stays null with 0 lines. A document that
    loses nothing keeps its text as it was; one that loses every line becomes empty.
    """
    runs = repeated_runs(docs, min_lines, id_col, text_col, min_words)
    d, t, r = (unused(c, docs.columns) for c in ("_d", "_t", "_runs"))
    keyed = docs.withColumn(t, F.xxhash64(docs[text_col].cast("string")))
    runs = runs.select(F.col("d").alias(d), F.col("t").alias(f"{t}_2"), F.col("runs").alias(r))
    j = keyed.join(runs, keyed[id_col].eqNullSafe(runs[d]) & (keyed[t] == runs[f"{t}_2"]), "left")
    lines = F.split(F.col(text_col).cast("string"), "\n")
    gone = F.flatten(F.transform(r, lambda x: F.concat(F.array_repeat(F.lit(False), x["gap"]), F.array_repeat(F.lit(True), x["len"]))))
    kept = F.transform(F.array(F.struct(lines.alias("l"), gone.alias("g"))), lambda x: F.filter(
        x["l"], lambda line, i: ~F.coalesce(F.get(x["g"], i), F.lit(False))))[0]
    n_lines = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    removed = F.coalesce(F.aggregate(F.col(r), F.lit(0), lambda a, x: a + x["len"]), F.lit(0)).cast("long")
    text = F.when(F.col(r).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return j.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in counts],
                    n_lines.alias(counts[0]), removed.alias(counts[1]))
