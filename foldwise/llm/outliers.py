"""Quality rules: robust multivariate outliers by the minimum covariance determinant.

Per language and source a location and a covariance are estimated from the half of the
documents that spreads least, and a document is rejected when the Mahalanobis distance of
its transformed statistics is improbable. Everything is a column expression or a grouped
aggregate: statistics and matrices stay in the engine.

The statistics vary in typical text, so the estimated covariance and not a floor decides:
word length, share of marks, share of capitals, lines per word, distinct words per word. Each is
taken as the deviation from its group's median, weighted by sqrt(n / (n + PRIOR_WORDS)), as
shares of short texts scatter more, and scaled by the group's median absolute deviation.

Estimation (deterministic starts, then concentration steps): a first covariance comes from the
hyperbolic tangents of the scaled statistics, a second from their signs in space; both are
carried side by side. Each step takes the share ``COVERAGE`` of the group with the smallest
distances and its moments, and factors the covariance (Cholesky, written out as column
expressions). A step never raises the determinant but by the error of the approximate quantile;
steps are taken until no group's determinant falls any more, ``STEPS`` at least, for the groups of all
levels (source within language, language, all documents) side by side, and the start
that ends with the smaller determinant stays. Distances are scaled so that the median document of
a group has the median of the chi-square distribution. Equal vectors count once, so copies do
not become the half. A group's rows are only ever read by map-side combined aggregates, so a
source with a third of all documents is spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import stash

SPACE = "[\\x20\\x09-\\x0D]+"
NOT_SYMBOL = "[^#*$%&|<>]+"
NOT_MARK = "[\\p{L}\\p{M}\\p{N}\\x20\\x09-\\x0D]+"
NOT_UPPER = "[^\\p{Lu}]+"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30

COVERAGE = 0.5         # share of a group in the subset: up to half of a group may be outliers
STEPS = 4              # concentration steps at least
FALL = 1e-3            # a determinant falls when its logarithm goes this far below the lowest before
PRIOR_WORDS = 200.0    # words at which chance spreads a share as much as documents differ in it
MIN_GROUP = 40         # smaller groups borrow the estimate of their language, then of all documents
MIN_SPREAD = 0.1       # so do groups whose half spreads less than this part of the half of all documents
DIMS = 5
CHI_MEDIAN = 4.351     # median of chi-square(5)
CUTOFF = 80.0          # scaled squared distance above which a document is rejected: a chi-square(5) tail below
                       # 1e-14, as tails of real statistics are heavy
TINY_SCALE = 1e-3      # scale of a statistic that does not vary in a group (shares' roots and logarithms)
RIDGE = 1e-3           # added to each scaled variance, against singular matrices only


# ------------------------------------------------------------ base statistics
def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def windows(words: Column) -> Column:
    """Hashes of all windows of WINDOW words, from the words' hashes."""
    first = F.slice(words, 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))
    return F.transform(first, lambda h, i: F.xxhash64(h, *[F.get(words, i + k) for k in range(1, WINDOW)]))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more in the text; ``words`` are their hashes.

    Windows are compared by 64-bit hashes. Only texts with a repeated window pay for the
    search: positions sorted by hash, those with an equal neighbour kept, and the lengths of
    the windows' union added up.
    """

    def covered(at: Column) -> Column:
        follow = F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(follow, F.lit(0), lambda a, x: a + x).cast("long")

    def search(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def equal(s: Column) -> Column:
            hit = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
            return F.sort_array(F.transform(hit, lambda x: x["i"]))

        return _let(_let(placed, equal), covered)

    return _let(windows(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long"))
                .otherwise(search(h)))


def base_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    by: Sequence[str] = ("lang", "source")) -> DataFrame:
    """(id, by..., n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_marks, n_upper, n_lines,
    n_distinct) of every row.

    Counted over whole texts; a null text has no words, lines or symbols. Marks are characters of words
    that are no letter, combining mark or digit; n_lines counts lines with a word; distinct words are
    told apart by 64-bit hashes.
    """
    t = F.coalesce(F.col("_t"), F.lit(""))
    words = F.array_remove(F.split(t, SPACE), "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    d = docs.select(docs[id_col].alias("id"), *[docs[c].alias(f"by_{c}") for c in by],
                    docs[text_col].cast("string").alias("_t"))
    words_of = _let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("c"),
        _let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.struct(
            repeated_words(h).alias("r"), F.size(F.array_distinct(h)).cast("long").alias("u"))).alias("h")))
    lines_of = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"),
                                              (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))

    # symbols are marks: they are counted in what is left of the text without the rest
    marks_of = _let(F.regexp_replace(t, NOT_MARK, ""), lambda m: F.struct(
        F.length(m).cast("long").alias("n"), F.length(F.regexp_replace(m, NOT_SYMBOL, "")).cast("long").alias("s")))
    names = ["id", *[f"by_{c}" for c in by]]
    return d.select(*names, words_of.alias("w"), lines_of.alias("l"), marks_of.alias("m"),
                    F.length(F.regexp_replace(t, NOT_UPPER, "")).cast("long").alias("n_upper")
                    ).select(*names, F.col("w.n").alias("n_words"), F.col("w.c").alias("word_chars"),
                             F.col("m.s").alias("n_symbols"), F.col("l.d").alias("n_dup_lines"),
                             F.col("w.h.r").alias("n_repeat_words"), F.col("m.n").alias("n_marks"), "n_upper",
                             F.col("l.n").alias("n_lines"), F.col("w.h.u").alias("n_distinct"))


def transformed() -> list[Column]:
    """The statistic vector, on scales where typical text is near normal."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return [F.log((F.col("word_chars") + 1) / n), F.sqrt(F.col("n_marks") / chars), F.sqrt(F.col("n_upper") / chars),
            F.log((F.col("n_lines") + 1) / (n + 1)), F.log((F.col("n_distinct") + 1) / (n + 1))]


# ------------------------------------------------------------ minimum covariance determinant
def _factored(sums: DataFrame, keys: Sequence[str], centred: bool = True) -> DataFrame:
    """Mean and lower Cholesky factor of each covariance from counts, sums and sums of products."""
    out = sums.withColumns({f"mu{i}": F.col(f"t{i}") / F.col("m") if centred else F.lit(0.0) for i in range(DIMS)})
    for i in range(DIMS):
        for j in range(i + 1):
            c = F.col(f"p{i}{j}") / F.col("m") - F.col(f"mu{i}") * F.col(f"mu{j}") + F.lit(RIDGE if i == j else 0.0)
            for k in range(j):
                c = c - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(c, F.lit(RIDGE * 0.01))) if i == j else c / F.col(f"l{j}{j}"))
    return out.select(*keys, *[f"mu{i}" for i in range(DIMS)], *[f"l{i}{j}" for i in range(DIMS) for j in range(i + 1)])


def _sums(v: Sequence[Column]) -> list[Column]:
    return [F.count(v[0]).alias("m"), *[F.sum(x).alias(f"t{i}") for i, x in enumerate(v)],
            *[F.sum(v[i] * v[j]).alias(f"p{i}{j}") for i in range(DIMS) for j in range(i + 1)]]


def _distance(z: Sequence[Column]) -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    y = []
    for i in range(DIMS):
        v = z[i] - F.col(f"mu{i}")
        for k in range(i):
            v = v - F.col(f"l{i}{k}") * y[k]
        y.append(v / F.col(f"l{i}{i}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _median(value: Column, share: float = 0.5) -> Column:
    return F.percentile_approx(value, share, 1000)


def _z() -> list[Column]:
    return [F.col(f"z{i}") for i in range(DIMS)]


def _scaled() -> list[Column]:
    return [(F.col(f"x{i}") - F.col(f"a{i}")) * F.col("w") / F.col(f"s{i}") for i in range(DIMS)]


def _join(rows: DataFrame, est: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Rows with their group's estimates; joined by key (AQE broadcasts them when their measured size allows
    it, else splits hot keys), or the one row of estimates of all documents."""
    est = est.withColumnsRenamed({k: f"e_{k}" for k in keys})
    if not keys:
        return rows.join(F.broadcast(est), F.lit(True), how)
    return rows.join(est, [rows[k].eqNullSafe(est[f"e_{k}"]) for k in keys], how).drop(*[f"e_{k}" for k in keys])


def mcd(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Estimates per group of ``keys`` over the columns w, x0, x1, ...; one row a group: members m, centre a,
    scale s, location mu and Cholesky factor l of the scaled statistics, factor ``unit`` of squared
    distances, logarithm ``spread`` of the half's mean standard deviation."""
    keys = list(keys)
    centre = stash(rows.groupBy(*keys).agg(*[_median(F.col(f"x{i}")).alias(f"a{i}") for i in range(DIMS)]), "mcd-median")
    scale = _join(rows, centre, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("m"), *[F.first(f"a{i}").alias(f"a{i}") for i in range(DIMS)],
        *[F.greatest(_median(F.abs((F.col(f"x{i}") - F.col(f"a{i}")) * F.col("w"))) * 1.4826, F.lit(TINY_SCALE)).alias(f"s{i}")
          for i in range(DIMS)])
    scale = stash(scale, "mcd-scale")
    scaled = _scaled()
    one = stash(_join(rows, scale, keys).select(*keys, *[c.alias(f"z{i}") for i, c in enumerate(scaled)]), "mcd-scaled")
    both = one.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    by = [*keys, "start"]
    length = F.sqrt(sum((z * z for z in _z()[1:]), _z()[0] * _z()[0]))
    first = [F.when(F.col("start") == 0, F.tanh(z)).otherwise(F.when(length > 0, z / length).otherwise(0.0)) for z in _z()]
    first = both.select(*by, *[c.alias(f"z{i}") for i, c in enumerate(first)])
    est = stash(_factored(first.groupBy(*by).agg(*_sums(_z())), by, centred=False), "mcd")
    det = sum((F.log(f"l{i}{i}") for i in range(1, DIMS)), F.log("l00"))
    step, low = 0, None
    while True:
        # both starts' distances in one row: half the groups, which the quantile's aggregate then need not sort
        d = one
        for start in (0, 1):
            d = _join(d, est.where(F.col("start") == start).drop("start"), keys).select(
                *keys, *_z(), *[f"d{s}" for s in range(start)], _distance(_z()).alias(f"d{start}"))
        cut = d.groupBy(*keys).agg(*[_median(F.col(f"d{s}"), COVERAGE).alias(f"cut{s}") for s in (0, 1)])
        cut = stash(cut.select(*keys, F.posexplode(F.array("cut0", "cut1")).alias("start", "cut")), "mcd-cut")
        d = _join(both, est, by).select(*by, *_z(), _distance(_z()).alias("d2"))
        inside = _join(d, cut, by).where(F.col("d2") <= F.col("cut"))
        est = stash(_factored(inside.groupBy(*by).agg(*_sums(_z())), by), "mcd")
        step += 1
        if step < STEPS - 1:
            continue
        now = est.select(*by, det.alias("now"))
        if low is None:
            low = stash(now.withColumnRenamed("now", "low"), "mcd-low")
            continue
        pair = _join(now, low, by)
        if pair.where(2 * F.col("now") < 2 * F.col("low") - FALL).isEmpty():
            break
        low = stash(pair.select(*by, F.least("now", "low").alias("low")), "mcd-low")
    est = est.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in est.columns if c not in by]), F.struct(det, "start")).alias("e"),
                                 F.min(det).alias("det")).select(*keys, "e.*", "det")
    est = stash(_join(scale, est, keys), "mcd-best")
    unit = _join(one, est, keys).groupBy(*keys).agg(_median(_distance(_z())).alias("d2"))
    unit = unit.select(*keys, (CHI_MEDIAN / F.greatest("d2", F.lit(RIDGE))).alias("unit"))
    spread = sum((F.log(f"s{i}") for i in range(1, DIMS)), F.log("s0"))
    return stash(_join(est, unit, keys).withColumn("spread", (F.col("det") + spread) / DIMS).drop("det"), "mcd-unit")


def judge(stats: DataFrame, by: Sequence[str] = ("lang", "source")) -> DataFrame:
    """``stats`` with base_failed, distance2 and kept.

    The estimates come from the distinct vectors of documents that pass the base rules. A group with
    fewer than ``MIN_GROUP`` of them, or whose half hardly spreads (``MIN_SPREAD``: near copies of one
    text), is judged by the estimate of its first key, then of all documents; with none at all every
    document that passes the base rules is kept. Null keys form groups.
    """
    keys = [f"by_{c}" for c in by]
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT)
    x = stats.withColumn("base_failed", failed).withColumn("w", F.sqrt(F.col("n_words") / (F.col("n_words") + PRIOR_WORDS)))
    x = stash(x.withColumns({f"x{i}": c.cast("double") for i, c in enumerate(transformed())}), "statistics")
    good = stash(x.where(~F.col("base_failed")).select(*keys, "w", *[f"x{i}" for i in range(DIMS)]).distinct(), "vectors")
    # every level's groups side by side: one loop of steps for all of them
    levels = good.withColumn("level", F.explode(F.array(*[F.lit(i) for i in range(len(keys) + 1)])))
    est = mcd(levels.withColumns({k: F.when(F.col("level") > i, F.col(k)) for i, k in enumerate(keys)}), ["level", *keys])
    whole = est.where("level = 0").select(F.col("spread").alias("all_spread"))
    usable = (F.col("m") >= MIN_GROUP) & (F.col("spread") >= F.col("all_spread") + F.log(F.lit(MIN_SPREAD)))
    est = stash(_join(est, whole, [], "left").where((F.col("level") == 0) | usable).drop("m", "spread", "all_spread"), "mcd-usable")
    names, out = [], x
    for level in range(len(keys), -1, -1):
        j = _join(out, est.where(F.col("level") == level).drop("level", *keys[level:]), keys[:level], "left")
        out = j.select(*out.columns, (_distance(_scaled()) * F.col("unit")).alias(f"d2_{level}"))
        names.append(f"d2_{level}")
    d2 = F.coalesce(*[F.col(n) for n in names])
    return out.select(*stats.columns, "base_failed", d2.alias("distance2"),
                      (~F.col("base_failed") & F.coalesce(d2 <= CUTOFF, F.lit(True))).alias("kept"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  by: Sequence[str] = ("lang", "source")) -> DataFrame:
    """(id, statistics, base_failed, distance2, kept, more statistics) of every row of ``docs``."""
    more = ["n_marks", "n_upper", "n_lines", "n_distinct"]
    out = judge(base_statistics(docs, id_col, text_col, by), by).drop(*[f"by_{c}" for c in by])
    return out.select(F.col("id").alias(id_col), *[c for c in out.columns if c not in ("id", *more)], *more)
