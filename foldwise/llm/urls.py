"""URL filters: host and path rules, and a ratio of character language models for the rest.

URLs that a rule accepts or rejects train one character model each. A model is a Markov model
of variable order: the probability of a character is interpolated over its contexts of 0 to
``ORDER`` characters, from the shortest to the longest one seen, each weighing its own counts
against the number of different characters that followed it (Witten-Bell smoothing). A URL's
score is the difference of the two log-likelihoods, divided by its number of characters. Every
fifth text of the ruled URLs is held out: there the threshold is set at which the shares of
accepted URLs above and of rejected ones below it have the largest sum.

All counts are grouped tables over all ruled URLs. A difference of logarithms is computed once
per distinct run of ``ORDER`` + 1 characters and kept in whole millionths, so that sums do not
depend on their order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import stash, unused

ORDER = 5           # characters of the longest context
HELD_OUT = 5        # of every so many ruled texts one calibrates
STEP = 20_000       # millionths of a nat a character between possible thresholds
STEPS = 500         # possible thresholds on either side of zero
MOST_RULES = 1_000  # rules of a filter
BROADCAST_BYTES = 32 << 20
BEGIN, FINISH = "\x02", "\x03"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DIGITS = "123456789"

ALLOW, BLOCK = "allow", "block"
#: (host, path, verdict)
RULES = (("com", "/", ALLOW), ("example.com", "/en/", BLOCK), ("www.example.com", "/en/", ALLOW),
         ("net", "/es/", BLOCK), ("net", "/fr/", BLOCK))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    parts = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, parts, 1), UPPER, LOWER), F.regexp_extract(text, parts, 2)


def matched(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null. A rule fits its host and all
    subdomains of it, on paths that start with the rule's; of equally long ones the first wins."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    if not all(v in (ALLOW, BLOCK) for _, _, v in rules):
        raise ValueError(f"a rule's verdict is {ALLOW} or {BLOCK}")
    fits = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p),
                   F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
            for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1]))]
    return F.coalesce(*fits, F.lit(None).cast("struct<rule:string,verdict:string>"))


def model_text(url: Column) -> Column:
    """What the models read: all after the first ``://``, A-Z lower-cased, digits as one character."""
    text = F.coalesce(url, F.lit(""))
    at = F.locate("://", text)
    return F.translate(F.when(at > 0, text.substr(at + 3, F.length(text))).otherwise(text), UPPER + DIGITS, LOWER + "0" * 9)


def _grams(text: Column) -> Column:
    """Each character of ``text``, and its end, after ``ORDER`` characters of context."""
    padded = F.concat(F.lit(BEGIN * ORDER), text, F.lit(FINISH))
    return F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{ORDER + 1}}}))."), F.lit(1))


def _suffixes(gram: Column) -> Column:
    """The runs that end ``gram``: 1 to ``ORDER`` + 1 characters."""
    return F.array(*[gram.substr(ORDER + 1 - k, k + 1) for k in range(ORDER + 1)])


def _lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join on ``key``; the written ``table`` is broadcast only if its rows are measured to be
    few, else both sides are exchanged, where a hot key is split at run time."""
    width = 16 * len(table.columns) + 32
    if table.count() * width <= BROADCAST_BYTES:
        table = F.broadcast(table)
    return rows.join(table, key, "left")


def count_tables(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts of the models from (text, accepted): (run, na, nr) of every run of 1 to ``ORDER`` + 1
    characters, and (context, ta, ua, tr, ur): occurrences and different followers per class."""
    grams = texts.select(F.explode(_grams(F.col("text"))).alias("gram"), "accepted").groupBy("gram").agg(
        F.sum(F.col("accepted").cast("long")).alias("na"), F.sum((~F.col("accepted")).cast("long")).alias("nr"))
    runs = grams.select(F.explode(_suffixes(F.col("gram"))).alias("run"), "na", "nr").groupBy("run").agg(
        F.sum("na").alias("na"), F.sum("nr").alias("nr"))
    runs = stash(runs, "url-runs")
    contexts = runs.groupBy(F.col("run").substr(F.lit(1), F.length("run") - 1).alias("context")).agg(
        F.sum("na").alias("ta"), F.sum((F.col("na") > 0).cast("long")).alias("ua"),
        F.sum("nr").alias("tr"), F.sum((F.col("nr") > 0).cast("long")).alias("ur"))
    return runs, stash(contexts, "url-contexts")


def gram_scores(grams: DataFrame, runs: DataFrame, contexts: DataFrame) -> DataFrame:
    """(gram, diff): difference of the log-probabilities of the last character, in millionths."""
    size = runs.where(F.length("run") == 1).agg(F.count(F.lit(1)).alias("n")).first().n + 1
    rows = grams.select("gram", F.posexplode(_suffixes(F.col("gram"))).alias("k", "run"))
    rows = rows.withColumn("context", F.col("run").substr(F.lit(1), F.col("k")))
    rows = _lookup(_lookup(rows, runs, "run"), contexts, "context")
    zero = [F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("na", "ta", "ua", "nr", "tr", "ur")]
    steps = rows.groupBy("gram").agg(F.array_sort(F.collect_list(F.struct("k", *zero))).alias("s"))  # ORDER + 1 rows a gram

    def probability(n: str, total: str, unlike: str) -> Column:
        return F.aggregate("s", F.lit(1.0 / size), lambda p, x: F.when(
            x[total] > 0, (x[n] + x[unlike] * p) / (x[total] + x[unlike])).otherwise(p))

    diff = F.log(probability("na", "ta", "ua")) - F.log(probability("nr", "tr", "ur"))
    return steps.select("gram", F.round(diff * 1e6).cast("long").alias("diff"))


def text_scores(texts: DataFrame, runs: DataFrame, contexts: DataFrame) -> DataFrame:
    """(row, total, n): a text's summed differences and its number of characters with the end."""
    grams = texts.select("row", F.explode(_grams(F.col("text"))).alias("gram"))
    known = stash(gram_scores(grams.select("gram").distinct(), runs, contexts), "url-grams")
    return _lookup(grams, known, "gram").groupBy("row").agg(F.sum("diff").alias("total"), F.count(F.lit(1)).alias("n"))


def _step() -> Column:
    at = F.floor(F.col("total") / (F.col("n") * STEP))
    return F.least(F.greatest(at, F.lit(-STEPS)), F.lit(STEPS)).cast("int")


def threshold(scored: DataFrame) -> int:
    """The step from which on a URL is allowed, from (total, n, accepted) of held-out ruled URLs:
    0 if a class is missing; of equally good ones the closest to 0, then the lower. Only the
    counts of at most 2 * ``STEPS`` + 1 steps come to the driver."""
    counts = {r.step: (r.a, r.r) for r in scored.groupBy(_step().alias("step")).agg(
        F.sum(F.col("accepted").cast("long")).alias("a"), F.sum((~F.col("accepted")).cast("long")).alias("r")).collect()}
    all_a, all_r = (sum(c[i] for c in counts.values()) for i in (0, 1))
    if not all_a or not all_r:
        return 0
    best, rejected_below, accepted_below = (None, 0), 0, 0
    for at in range(-STEPS, STEPS + 1):
        gain = (all_a - accepted_below) * all_r + rejected_below * all_a
        order = (gain, -abs(at), -at)
        if best[0] is None or order > best[0]:
            best = (order, at)
        a, r = counts.get(at, (0, 0))
        accepted_below, rejected_below = accepted_below + a, rejected_below + r
    return best[1]


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id",
                url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, score) of every row of ``pages``.

    ``verdict`` is that of the longest rule that fits, else ``allow`` if the score of the two
    models reaches the calibrated threshold, else ``block``; ``score`` (nats a character) is null
    where a rule decides. A null URL counts as empty and, as one without ``://``, has no host and
    no path; the models judge it as any other. Without any ruled URL every score is 0 and the
    verdict ``allow``. Repeated rows are judged alike and count as often as they stand. Only the
    two columns are read; others never clash.
    """
    key, url = unused("key", [id_col]), F.col("url")
    host, path = host_and_path(url)
    rows = pages.select(pages[id_col].alias(key), pages[url_col].cast("string").alias("url")).select(
        F.monotonically_increasing_id().alias("row"), F.col(key), host.alias("host"), path.alias("path"), model_text(url).alias("text"))
    held = F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 8), 16, 10).cast("long") % HELD_OUT == 0
    rows = stash(rows.select("*", matched(F.col("host"), F.col("path"), rules).alias("m"), held.alias("held")), "urls")
    ruled = F.col("m").isNotNull()
    runs, contexts = count_tables(rows.where(ruled & ~F.col("held")).select("text", (F.col("m.verdict") == ALLOW).alias("accepted")))
    scored = stash(text_scores(rows.where(~ruled | F.col("held")).select("row", "text"), runs, contexts), "url-scores")
    known = rows.where(ruled & F.col("held")).select("row", (F.col("m.verdict") == ALLOW).alias("accepted"))
    at = threshold(scored.join(known, "row"))
    judged = scored.select("row", F.when(_step() >= at, ALLOW).otherwise(BLOCK).alias("judged"),
                           (F.col("total") / F.col("n") / 1e6).alias("score"))
    return rows.join(judged, "row", "left").select(
        F.col(key).alias(id_col), "host", "path", F.col("m.rule").alias("rule"),
        F.coalesce("m.verdict", "judged").alias("verdict"), F.when(~ruled, F.col("score")).alias("score"))
