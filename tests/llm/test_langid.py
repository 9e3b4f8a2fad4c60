"""Cross-parsing language identification against a naive parse, and held-out accuracy."""

import random

import numpy as np
import pytest

from foldwise.llm.langid import BLOCK, UNDETERMINED, fit, identify, learn
from foldwise.llm.queries import op5_language_id

SF = "/root/testdata/sf0.1"


def naive_phrases(codes, train):
    """Longest matches by search in the training text, in blocks."""
    text = "".join(map(chr, train))
    count = 0
    for at in range(0, len(codes), BLOCK):
        block = "".join(map(chr, codes[at:at + BLOCK]))
        i = 0
        while i < len(block):
            j = i + 1
            while j < len(block) and block[i:j + 1] in text:
                j += 1
            count += 1
            i = j
    return count


def test_phrases_match_a_naive_parse():
    rnd = random.Random(2)
    train = {"x": ["".join(rnd.choices("abcd é", k=900))], "y": ["".join(rnd.choices("cdef ü", k=900))]}
    model = learn(train)
    texts = ["".join(rnd.choices("abcdefé üzß 1,", k=n)) for n in (1, 5, 60, 511, 512, 513, 1500)]
    count, chars, letters = model.phrases(texts)
    for k, lang in enumerate(model.langs):
        raw = model.classes[[ord(c) for c in train[lang][0]]]
        raw = raw[np.r_[True, (raw[1:] != 0) | (raw[:-1] != 0)]]
        for i, t in enumerate(texts):
            c = model.classes[[ord(x) for x in t]]
            c = c[np.r_[True, (c[1:] != 0) | (c[:-1] != 0)]]
            assert count[i, k] == naive_phrases(c, raw)
            assert chars[i] == len(c)


def test_held_out_accuracy(spark):
    out = op5_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = out.where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_long_texts_do_not_depend_on_their_neighbours():
    model = learn({"x": ["the cat sat on the mat " * 20], "y": ["der hund lag auf dem sofa " * 20]})
    long = "the cat and der hund " * 60_000
    together, alone = model.predict(["a cat", long, None]), model.predict([long])
    assert together[0][1] == alone[0][0] and together[1][1] == alone[1][0]


def test_edges(spark):
    rows = [(1, "the cat sat on the mat", "en"), (2, "der hund lag auf dem sofa", "de"), (3, None, "en"), (4, "", None),
            (5, "123 ... !!", "en"), (None, "the mat", None), (2, "der hund", "xx"), (2, "der hund", "xx")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    model = fit(docs, docs.doc_id < 3)
    out = {(r.doc_id, r.lang_pred) for r in identify(docs, model).collect()}
    assert {(3, UNDETERMINED), (4, UNDETERMINED), (5, UNDETERMINED), (1, "en"), (None, "en")} <= out
    assert identify(docs, model).count() == len(rows)
    empty = docs.where("false")
    assert fit(empty, empty.doc_id < 3) is None
    assert {r.lang_pred for r in identify(docs, None).collect()} == {UNDETERMINED}
    assert identify(empty, model).count() == 0
    with pytest.raises(ValueError, match="languages"):
        fit(docs, docs.doc_id < 3, max_langs=1)
