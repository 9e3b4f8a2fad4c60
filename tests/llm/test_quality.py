"""Factorisation machine: the linear-time identity, its gradient, and held-out accuracy."""

import numpy as np

from foldwise.llm import quality as Q
from foldwise.llm.queries import op8_quality

SF = "/root/testdata/sf0.1"


def machine(rng):
    size = (1 << Q.WORD_BITS) + Q.N_STATS * (1 + Q.BINS)
    return Q.FactorisationMachine(np.zeros(Q.N_STATS), np.ones(Q.N_STATS), np.zeros((Q.N_STATS, Q.BINS - 1)), 0.3,
                                  rng.normal(size=size), rng.normal(size=(size, Q.RANK)))


def test_score_equals_the_sum_over_all_pairs():
    rng = np.random.default_rng(0)
    fm = machine(rng)
    parts = [Q.stats_and_words(t) for t in ("a small text of words words", "", None, "x\ny z " * 40)]
    f, x, lens = fm.design(*Q._rows(parts))
    got = fm.forward(f, x, lens)[0]
    at = 0
    for i, n in enumerate(lens):
        g, v = f[at:at + n], x[at:at + n]
        pairs = sum(fm.v[g[a]] @ fm.v[g[b]] * v[a] * v[b] for a in range(n) for b in range(a + 1, n))
        assert np.isclose(got[i], fm.bias + fm.w[g] @ v + pairs)
        at += n


def test_whole_texts_count():
    head = "the same words again and again " * 2000
    assert not np.array_equal(Q.stats_and_words(head)[0], Q.stats_and_words(head + "### " * 50)[0])


def test_held_out_accuracy(spark):
    out = op8_quality(spark, SF)
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = out.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    y, s = np.array([r.quality for r in rows]), np.array([r.score for r in rows])
    assert ((s >= 0) & (s <= 1)).all()
    rank = np.argsort(np.argsort(s))
    p = y.sum()
    assert (rank[y == 1].sum() - p * (p - 1) / 2) / (p * (len(y) - p)) > 0.99
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.98


def test_edges(spark):
    docs = spark.createDataFrame([(1, "good words here", 1.0), (2, "### $$$ ###", 2.0), (3, None, 0.0), (None, "x", 0.0),
                                  (1, "good words here", 1.0), (4, "w " * 200_000, 0.0)],
                                 "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, None), (None, 1), (9, 0)], "doc_id long, quality int")
    model = Q.fit(docs, labels, labels.doc_id > 0)
    out = Q.score(docs, model, keep=["doc_id"])
    assert out.count() == 6 and out.columns == ["doc_id", "score"]
    assert all(0 <= r.score <= 1 for r in out.collect())
    assert Q.fit(docs, labels.where("quality = 1"), labels.doc_id > 0) is None
    assert Q.fit(docs.where("false"), labels, labels.doc_id > 0) is None
    assert {r.score for r in Q.score(docs, None).collect()} == {0.5}
    assert Q.score(docs.where("false"), model).count() == 0
