"""Spelling variants by permuterm rotations.

Every word gets a terminator and is rotated to each of its places, so what precedes a place
stands last. Words that differ by one character at a place then share the rotation from there
on up to, but without, its last character (replaced), and a word that lacks the character has
that prefix as a whole rotation of its own (inserted or deleted). The rotations are sorted by
this prefix and each range of equal ones is scanned: it holds one whole rotation at most, and
one member for each character of the alphabet, so a range stays small however common a word is.
A range is summed up for each of its members; its pairs are never listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.llm.common import discard, stash

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END = "$"          # the terminator; no run holds it
MIN_LENGTH = 5     # code points of a word
MIN_COUNT = 3      # occurrences of a word
DELETE_EVERY = 97  # a run whose crc32 this divides loses a code point
RATIO = 2          # a form is at least so many times as frequent
LONG = 128         # prefixes longer than this are held by their md5


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the runs of letters of all whole texts; a run whose crc32 with its document's
    key is divisible by ``DELETE_EVERY`` lacks one code point. A null text has no run, a null key
    counts as the empty text. Counts are combined in each task before they are shuffled."""
    text = docs[text_col].cast("string")
    runs = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("d"),
                       F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.select("d", F.translate("run", UPPER, LOWER).alias("run"), F.length("run").alias("size")).where(
        F.col("size") >= min_length)
    h = F.crc32(F.concat("d", F.lit(":"), "run").cast("binary"))
    at = F.pmod(F.col("h"), F.col("size")).cast("int")
    left = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.col("size")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % DELETE_EVERY == 0, left).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") >= min_count)


def _held(prefix: Column) -> Column:
    return F.when(F.length(prefix) > LONG, F.md5(prefix.cast("binary"))).otherwise(prefix)


def rotations(words: DataFrame) -> DataFrame:
    """(key, whole, first, rank): each rotation as a whole, and without its last character.

    ``first`` marks the places that do not repeat the character before them; deleting any
    character of such a repetition gives the same word, so counts take the first of them.
    """
    marked, size = F.concat("word", F.lit(END)), F.length("word")
    at = words.select("rank", "word", marked.alias("marked"), size.alias("size"), F.explode(F.sequence(F.lit(0), size)).alias("i"))
    i, m = F.col("i"), F.col("marked")
    at = at.select("rank", "size", "i", F.concat(m.substr(i + 1, F.col("size") + 1), m.substr(F.lit(1), i)).alias("rotation"),
                   ((i == 1) | (m.substr(i - 1, F.lit(1)) != m.substr(i, F.lit(1)))).alias("first"))
    whole = F.struct(_held(F.col("rotation")).alias("key"), F.lit(True).alias("whole"), F.lit(True).alias("first"))
    short = F.struct(_held(F.col("rotation").substr(F.lit(1), F.col("size"))).alias("key"), F.lit(False).alias("whole"),
                     F.col("first").alias("first"))
    both = F.when(i == 0, F.array(whole)).otherwise(F.array(whole, short))
    return at.select("rank", F.explode(both).alias("r")).select("rank", "r.key", "r.whole", "r.first")


def near_words(words: DataFrame) -> DataFrame:
    """(rank, n_near, best) of every word that has a near one; ``best`` is the least rank of these.

    ``words`` has the columns word and rank, ranks ascending from the most frequent word (ties in
    code-point order).
    """
    in_order = Window.partitionBy("key").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    r = rotations(words).withColumns({
        "low": F.first("rank").over(in_order),
        "next": F.nth_value("rank", 2).over(in_order),
        "n_short": F.sum((~F.col("whole")).cast("long")).over(in_order),
        "n_first": F.sum((~F.col("whole") & F.col("first")).cast("long")).over(in_order),
        "n_whole": F.sum(F.col("whole").cast("long")).over(in_order),
    }).where(F.col("next").isNotNull())
    near = F.when(F.col("whole"), F.col("n_first")).otherwise(
        F.col("n_short") - 1 + F.when(F.col("first"), F.col("n_whole")).otherwise(0))
    best = F.when(F.col("rank") == F.col("low"), F.col("next")).otherwise(F.col("low"))
    return r.groupBy("rank").agg(F.sum(near).alias("n_near"), F.min(best).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(rank, root) of every word with a form: the last word on its chain of forms.

    A form is at least ``RATIO`` times as frequent as its word, so chains end after the logarithm
    of the largest count; each round doubles the links that a word has followed.
    """
    now = stash(forms.select("rank", F.col("form").alias("root")), "forms")
    while True:
        ahead = now.select(F.col("rank").alias("_at"), F.col("root").alias("_next"))
        new = stash(now.join(ahead, F.col("root") == F.col("_at"), "left").select(
            "rank", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        discard(now)
        moved = not new.where("moved").isEmpty()
        now = new
        if not moved:
            return now.select("rank", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                      min_count: int = MIN_COUNT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of at least ``min_length`` code points
    and ``min_count`` occurrences in the texts (A-Z lower-cased; see ``word_counts``).

    Two words are near when they differ by one inserted, deleted or replaced code point. ``form``
    is the near word of the largest n (ties: smallest in code-point order) if that is at least
    twice the word's n, else null; ``root`` is reached by following forms, or the word itself.
    Repeated rows count as often as they stand; no words give no rows; other columns are not read.
    """
    # a sorted table: the ids ascend with the order, also between its files
    words = stash(word_counts(docs, id_col, text_col, min_length, min_count).orderBy(F.desc("n"), "word").withColumn(
        "rank", F.monotonically_increasing_id()), "words")
    near = stash(near_words(words), "near-words")
    known = words.select(F.col("rank").alias("best"), F.col("n").alias("best_n"))
    near = near.join(words.select("rank", "n"), "rank").join(known, "best").select(
        "rank", "n_near", F.when(F.col("best_n") >= RATIO * F.col("n"), F.struct(F.col("best").alias("form"), "best_n")).alias("f"))
    near = stash(near.select("rank", "n_near", "f.form", F.col("f.best_n").alias("form_n")), "forms-near")
    root = roots(near.where("form IS NOT NULL"))

    def named(rank: str, name: str) -> DataFrame:
        return words.select(F.col("rank").alias(rank), F.col("word").alias(name))

    ends = near.join(root, "rank", "left").join(named("form", "form_word"), "form", "left").join(
        named("root", "root_word"), "root", "left")
    ends = stash(ends.select("rank", "n_near", "form_word", "root_word", "form_n"), "named")
    return words.join(ends, "rank", "left").select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("form_n"))
