"""Quality rules: base statistics against a plain count, the estimates against numpy."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.llm import outliers as O

SF = "/root/testdata/sf0.1"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(words) - O.WINDOW + 1):
        at.setdefault(tuple(words[i:i + O.WINDOW]), []).append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(O.WINDOW)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))


def test_base_statistics_match_a_plain_count(spark):
    rnd = random.Random(4)
    pool = ["a", "b", "é", "中#", "*|", "\n", "\r\n", " ", "\t", "\x0b", " ", "word", "<&>"]
    texts = [None, "", " ", "\n\n", "x " * 9, "one two three four five six seven eight " * 3, "a b " * 4000,
             *["".join(x + rnd.choice([" ", "  ", "\n", ""]) for x in rnd.choices(pool, k=rnd.randint(0, 60))) for _ in range(300)]]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_words int")
    docs = docs.unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr(
        "doc_id + 10000 as doc_id", "text", "lang", "source", "1 as n_words"))
    want = {r.doc_id: plain(r.text) for r in docs.collect()}
    for r in O.base_statistics(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[r.id], r.id


def vectors(rows):
    """Statistic vectors and weights of ``rows``, as a plain computation."""
    c = {k: rows[k].to_numpy(float) for k in ("n_words", "word_chars", "n_marks", "n_upper", "n_lines", "n_distinct")}
    n, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    x = np.stack([np.log((c["word_chars"] + 1) / n), np.sqrt(c["n_marks"] / chars), np.sqrt(c["n_upper"] / chars),
                  np.log((c["n_lines"] + 1) / (n + 1)), np.log((c["n_distinct"] + 1) / (n + 1))], axis=1)
    return x, np.sqrt(c["n_words"] / (c["n_words"] + O.PRIOR_WORDS))


def median(x):
    return np.quantile(x, 0.5, axis=0, method="inverted_cdf")


def numpy_mcd(x, w):
    """Scaled squared distances of the rows to the estimate from their distinct vectors."""
    u = np.unique(np.column_stack([x, w]), axis=0)
    centre = median(u[:, :-1])
    scale = np.maximum(1.4826 * median(np.abs((u[:, :-1] - centre) * u[:, -1:])), O.TINY_SCALE)
    z = (u[:, :-1] - centre) * u[:, -1:] / scale

    def distance(z, mu, cov):
        return np.einsum("ij,jk,ik->i", z - mu, np.linalg.inv(cov + O.RIDGE * np.eye(O.DIMS)), z - mu)

    best = None
    for first in (np.tanh(z), z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)):
        mu, cov = np.zeros(O.DIMS), first.T @ first / len(z)
        for _ in range(20):
            d = distance(z, mu, cov)
            half = z[d <= median(d)]
            mu, cov = half.mean(axis=0), np.cov(half.T, bias=True)
        det = np.linalg.slogdet(cov + O.RIDGE * np.eye(O.DIMS))[1]
        if best is None or det < best[0]:
            best = det, mu, cov
    unit = O.CHI_MEDIAN / max(median(distance(z, *best[1:])), O.RIDGE)
    return distance((x - centre) * w[:, None] / scale, *best[1:]) * unit


def test_distances_match_numpy(spark):
    out = O.quality_rules(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = out.join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "source"), "doc_id").toPandas()
    x, w = vectors(rows)
    tested, verdicts, differ, plain_cut = 0, [], [], []
    passing = rows[~rows.base_failed]
    centre = median(x[passing.index])
    scale = 1.4826 * median(np.abs((x[passing.index] - centre) * w[passing.index, None]))
    for _, g in passing.groupby(["lang", "source"]):
        i = g.index.to_numpy()
        if len(g) < O.MIN_GROUP + 10:
            continue
        d = numpy_mcd(x[i], w[i])
        verdicts.append((d <= O.CUTOFF) == g.kept)
        differ.append(np.abs(d - g.distance2) / (1 + d))
        plain_cut.append(((((x[i] - centre) * w[i, None] / scale) ** 2).sum(axis=1) <= O.CUTOFF) == g.kept)
        tested += 1
    assert tested > 10
    assert np.concatenate(verdicts).mean() > 0.99
    assert np.median(np.concatenate(differ)) < 0.1
    print("verdicts that one median and fixed scales give too:", np.concatenate(plain_cut).mean())
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().merge(rows, on="doc_id")
    good = labels[(labels.quality == 1) & ~labels.base_failed]
    assert good.kept.mean() > 0.99
    assert labels[labels.quality == 0].kept.mean() < 0.1


def texts(rnd, n, caps, marks=0.1):
    """Texts whose share of capitals and of marks is drawn from the two ranges' lower and upper ends."""
    out = []
    for _ in range(n):
        up = rnd.uniform(*caps)
        words = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 9))) for _ in range(rnd.randint(100, 300))]
        words = [(w.upper() if rnd.random() < up else w) + ("," if rnd.random() < marks else "") for w in words]
        out.append("\n".join(" ".join(words[i:i + 12]) for i in range(0, len(words), 12)))
    return out


def test_groups_judge_the_same_text_by_their_own_covariance(spark):
    rnd = random.Random(21)
    odd = texts(rnd, 1, (0.5, 0.5))[0]
    rows = [(t, "en", s) for s, caps in (("wide", (0.0, 0.6)), ("narrow", (0.02, 0.06))) for t in [*texts(rnd, 150, caps), odd]]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in O.quality_rules(docs).collect()}
    kept = {s: [got[i] for i, r in enumerate(rows) if r[2] == s and r[0] == odd] for s in ("wide", "narrow")}
    assert kept == {"wide": [True], "narrow": [False]}
    assert sum(got.values()) >= len(rows) - 3


def test_copies_do_not_become_the_half(spark):
    """Exact and near copies that fill most of a group leave the other documents of it alone."""
    rnd = random.Random(22)
    rows = [(t, "en", s) for s in ("a", "b") for t in texts(rnd, 120, (0.02, 0.1))]
    one, two = texts(rnd, 2, (0.05, 0.05))
    rows += [(one, "en", "a")] * 400 + [(two + f"\nlast words {i}", "en", "b") for i in range(180)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    out = O.quality_rules(docs).collect()
    assert len(out) == len(rows)
    assert np.mean([r.kept for r in out if r.doc_id < 240]) > 0.98 and np.mean([r.kept for r in out if r.doc_id >= 240]) > 0.98


def test_plan_is_native(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = O.base_statistics(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_edges(spark):
    rows = [(i, "plain words of usual length " * 10, None if i % 3 else "en", "s") for i in range(60)]
    rows += [(100, None, "en", None), (101, "", None, None), (None, "### " * 50, "fr", "t"), (1, rows[1][1], "en", "s")]
    docs = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, lang string, source string, kept boolean")
    out = O.quality_rules(docs)
    assert out.count() == len(rows)
    got = {r.doc_id: r for r in out.collect()}
    assert got[100].base_failed and not got[100].kept and got[100].n_words == 0
    assert not got[None].kept
    assert O.quality_rules(docs.where("false")).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_partitions_do_not_matter(spark, parts):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    a = {tuple(r)[:7] for r in O.quality_rules(docs).collect()}
    assert a == {tuple(r)[:7] for r in O.quality_rules(docs.repartition(parts)).collect()}


def test_windows_have_equal_hashes_where_their_words_are_equal(spark):
    rnd = random.Random(6)
    rows = [[rnd.randint(0, 1) for _ in range(n)] for n in (0, 1, 7, 8, 9, 400)]
    out = spark.createDataFrame([(r,) for r in rows], "w array<bigint>").select("w", O.windows(F.col("w")).alias("h")).collect()
    for r in out:
        want = [tuple(r.w[i:i + O.WINDOW]) for i in range(len(r.w) - O.WINDOW + 1)]
        assert len(r.h) == len(want) and len(set(zip(r.h, want))) == len(set(want)) == len(set(r.h))


def test_outliers_up_to_almost_half_of_a_group(spark):
    """Documents of many symbols that pass the base rules do not become the estimate."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choices("abcdefghij", k=rnd.randint(2, 9)))
    rows = []
    for source, share in (("a", 0.1), ("b", 0.3), ("c", 0.4), ("d", 0.45)):
        for i in range(200):
            words = [word() for _ in range(rnd.randint(60, 200))]
            if i < 200 * share:
                words = [w + "#" * (rnd.random() < 0.6) + "|" * (rnd.random() < 0.3) for w in words]
            rows.append((len(rows), " ".join(words), "en", source, i < 200 * share))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, spam boolean")
    out = O.quality_rules(docs).collect()
    spam = {r[0]: r[4] for r in rows}
    assert not any(r.base_failed for r in out)
    assert all(r.kept != spam[r.doc_id] for r in out)
