"""Spelling variants against comparing all words with each other."""

import random
import re
import zlib
from collections import Counter

from foldwise.llm import variants as V


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def counted(rows):
    n = Counter()
    for key, text in rows:
        for run in re.findall(V.RUN, text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def brute(rows):
    n = counted(rows)
    form, out = {}, {}
    for w in n:
        close = [v for v in n if near(w, v)]
        best = min(close, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = len(close)
    rows = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n[w], out[w], n[form[w]] if form[w] else None))
    return sorted(rows)


def got(spark, rows, schema="doc_id long, text string"):
    out = V.spelling_variants(spark.createDataFrame(rows, schema))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in out.collect())


def test_random_words(spark):
    rnd = random.Random(12)
    base = ["".join(rnd.choices("abé", k=rnd.randint(5, 8))) for _ in range(30)]

    def edited(w):
        i = rnd.randrange(len(w))
        return rnd.choice([w[:i] + w[i + 1:], w[:i] + rnd.choice("abcÿ") + w[i:], w[:i] + rnd.choice("abcÿ") + w[i + 1:], w])

    rows = []
    for d in range(250):
        words = [edited(edited(w)) if rnd.random() < 0.4 else w for w in rnd.choices(base, [1 / (k + 1) for k in range(30)], k=40)]
        rows.append((d, rnd.choice([" ", ", ", "1", "\n"]).join(w.upper() if rnd.random() < 0.2 else w for w in words)))
    rows += rows[:5] + [(None, rows[0][1]), (900, None), (901, ""), (902, "1 2 $ ."), (None, None)]
    want = brute(rows)
    assert len(want) > 100 and any(r[1] for r in want) and any(r[2] not in (r[0], r[1]) for r in want)
    assert got(spark, rows) == want


def test_repeated_characters_ties_and_chains(spark):
    rows = [(0, " ".join(["aabbcc"] * 40 + ["abbcc"] * 20 + ["aabcc"] * 20 + ["abcc d"] * 9 + ["aaabbcc"] * 3 + ["abbbcc"] * 10))]
    assert got(spark, rows) == brute(rows)


def test_long_words_and_long_texts(spark):
    rnd = random.Random(5)
    long = "".join(rnd.choices("xyz", k=V.LONG + 1))
    words = [long, long[:50] + long[51:], long[:70] + "q" + long[71:], long + "e", "k" * 700, "k" * 701]
    rows = [(7, " ".join(w for k, w in enumerate(words) for _ in range(4 + 10 * (k % 2)))), (8, "filler words again " * 60_000)]
    want = brute(rows)
    assert len(want) > 6 and got(spark, rows) == want


def test_empty_and_clashing_columns(spark):
    assert got(spark, []) == []
    extra = [(1, "seven seven seven sevens sevens sevens", 3, "x", 1.0, 5)]
    out = got(spark, extra, "doc_id int, text string, rank int, word string, n double, n_near int")
    assert out == brute([(1, extra[0][1])])


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    n = counted([tuple(r) for r in docs.select("doc_id", "text").collect()])
    rows = {r.word: r for r in V.spelling_variants(docs).collect()}
    assert {w: r.n for w, r in rows.items()} == n
    for w in random.Random(3).sample(sorted(n), 60):
        close = [v for v in n if near(w, v)]
        assert rows[w].n_near == len(close)
        best = min(close, key=lambda v: (-n[v], v), default=None)
        assert rows[w].form == (best if best and n[best] >= 2 * n[w] else None)
