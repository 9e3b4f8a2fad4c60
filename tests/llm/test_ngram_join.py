"""N-gram join against all pairs; its parts against their definitions."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from foldwise.llm import ngram_join as J
from foldwise.llm.components import connected

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, num, den):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and den * k >= num * (len(sets[i]) + len(sets[j]) - k):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return sorted(((d, len(sets[i]), low.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def near_copies(seed, n_docs=150):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcde", k=k)) for k in rnd.choices(range(1, 9), k=300)]
    rows, bank = [], [rnd.choices(words, k=rnd.choice([1, 2, 3, 4, 5, 8, 14, 17, 30, 62, 66, 130, 260, 400])) for _ in range(25)]
    for i in range(n_docs):
        w = list(rnd.choice(bank))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, len(w) // 20, len(w) // 10])):
            at = rnd.randrange(len(w) + 1)
            w[at:at + rnd.choice([0, 1])] = [rnd.choice(words)] if rnd.random() < 0.6 else []
        rows.append((i, rnd.choice([" ", "\n"]).join(w)))
    return rows


@pytest.mark.parametrize("n,num,den,seed", [(3, 90, 100, 1), (3, 90, 100, 2), (5, 4, 5, 3), (2, 1, 2, 4), (1, 95, 100, 5)])
def test_all_pairs(spark, n, num, den, seed):
    rows = near_copies(seed) + [(900, None), (901, ""), (902, " \n"), (3, "A b"), (903, "a B"), (None, "a b")]
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, c int, component_id int").repartition(6)
    out = J.similarity_components(docs, n, num, den)
    assert out.columns == ["doc_id", "n_shingles", "class_id", "component_id"]
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=str) == brute(rows, n, num, den)


def test_linked_sets_share_a_partition():
    for num, den in ((90, 100), (4, 5)):
        rows = near_copies(num, 300)
        s = J.ShingleSets([t for _, t in rows], 3)
        row, key = J.partitions(s, num, den)
        mine = [set(key[row == i]) for i in range(len(rows))]
        sets = [shingles(t, 3) for _, t in rows]
        linked = 0
        for i in range(len(rows)):
            for j in range(i):
                k = len(sets[i] & sets[j])
                if k and den * k >= num * (len(sets[i]) + len(sets[j]) - k):
                    assert mine[i] & mine[j]
                    linked += 1
        assert linked > 100


def test_tree_lists_every_pair_within_the_bound():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 6, (40, 64))
    x = np.maximum(0, base[rng.integers(0, 40, 500)] + rng.integers(-1, 2, (500, 64)))
    y = np.maximum(0, base[rng.integers(0, 40, 90)] + (rng.random((90, 64)) < 0.05))
    nx, ny = x.sum(axis=1), y.sum(axis=1)
    q, at = J.CountTree(x, nx).search(y, ny, 9, 10)
    got = set(zip(q.tolist(), at.tolist()))
    assert len(got) == len(q)
    for i in range(len(y)):
        most = np.minimum(y[i], x).sum(axis=1)
        want = (10 * most >= 9 * (ny[i] + nx - most)) & (10 * nx >= 9 * ny[i]) & (10 * ny[i] >= 9 * nx)
        assert set(np.flatnonzero(want)) <= {b for a, b in got if a == i}
    assert len(got) < 0.5 * len(x) * len(y)


def _rows_of(texts, n, num, den, group):
    s = J.ShingleSets(texts, n)
    counts, ids = s.counts(), s.ids().view(np.int64)
    return pa.Table.from_pylist([
        {"p": g, "i": 0, "j": 0, "block": 0, "c": int(ids[k]), "n": int(s.size[k]), "component": int(ids[k]), "counts": counts[k],
         "halves": (s.token[s.start[k]:s.start[k] + s.size[k]].view(np.int64) >> 32).tolist()} for g, k in group])


@pytest.mark.parametrize("together", [256, 20])
def test_search_of_groups_lists_their_links(monkeypatch, together):
    """Groups of 1 to 150 sets, in the forest or in trees of their own, against all pairs."""
    monkeypatch.setattr(J, "TOGETHER", together)
    texts = sorted({t for _, t in near_copies(31, 300) if t.split()})
    rnd = random.Random(2)
    groups = [sorted(rnd.sample(range(len(texts)), min(k, len(texts)))) for k in (1, 2, 3, 15, 16, 17, 33, 60, 150)]
    rows = _rows_of(texts, 3, 9, 10, [(g, k) for g, m in enumerate(groups) for k in m])
    got = {(a, b) for batch in J._search(rows, 9, 10) for a, b in zip(*[c.to_pylist() for c in batch.columns])}
    sets = [shingles(t, 3) for t in texts]
    ids = J.ShingleSets(texts, 3).ids().view(np.int64)
    want = set()
    for m in groups:
        for x in m:
            for y in m:
                k = len(sets[x] & sets[y])
                if ids[x] < ids[y] and 10 * k >= 9 * (len(sets[x]) + len(sets[y]) - k):
                    want.add((int(ids[x]), int(ids[y])))
    assert len(want) > 20 and got == want


def test_intersections_by_sorting_and_by_products(monkeypatch):
    monkeypatch.setattr(J, "SLAB", 50)
    monkeypatch.setattr(J, "ELEMENTS", 500)
    rng = np.random.default_rng(9)
    sets = [np.sort(rng.choice(2000, rng.integers(1, 200), replace=False)) for _ in range(30)] + [np.zeros(0, dtype=np.int64)]
    t = J.Halves(pa.chunked_array([pa.array([x.tolist() for x in sets], pa.list_(pa.int64()))]))
    x, y = np.divmod(np.arange(31 * 31), 31)
    x, y = x[x != y], y[x != y]  # pairs are of different rows
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(x, y)]
    assert len(x) > 8 * 31 and t.common(x, y).tolist() == want
    assert [int(t.common(x[k:k + 20], y[k:k + 20])[3]) for k in range(0, 900, 20)] == [want[k + 3] for k in range(0, 900, 20)]


def test_trees_are_built_on_the_given_documents(spark, monkeypatch):
    """The partitions of sf0.01 are searched in trees: leaves bound rows before their members are read."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").select("text").distinct()
    texts = [r.text for r in docs.collect()]
    s = J.ShingleSets(texts, 3)
    row, key = J.partitions(s, 90, 100)
    members = {}
    for r, k in zip(row.tolist(), key.tolist()):
        members.setdefault(k, set()).add(r)
    group = [(g, k) for g, m in enumerate(m for m in members.values() if len(m) > 1) for k in sorted(m)]
    rows = _rows_of(texts, 3, 90, 100, group)
    seen, walk = [], J.forest_pairs
    monkeypatch.setattr(J, "forest_pairs", lambda v, n, start, size, *a: seen.append(len(start)) or walk(v, n, start, size, *a))
    links = sum(b.num_rows for b in J._search(rows, 90, 100))
    assert sum(seen) == len({g for g, _ in group}) > 100 and links > 0


def test_the_same_row_stays_whatever_the_partitions(spark):
    rows = [(1, "the same words in some rows of it", k % 5, str(k)) for k in range(40)] + [(2, None, 0, "x"), (2, None, 0, "x"), (3, " ", 1, "y")]
    kept = set()
    for parts in (1, 3, 8):
        docs = spark.createDataFrame(rows, "doc_id long, text string, n int, source string").repartition(parts)
        out = sorted(map(str, J.keep_one(docs, 3).collect()))
        assert len(out) == 4
        kept.add(tuple(out))
    assert len(kept) == 1


@pytest.mark.parametrize("many", [4, 1000])
def test_all_pairs_without_stars(spark, monkeypatch, many):
    monkeypatch.setattr(J, "STARS", 0)
    monkeypatch.setattr(J, "BLOCK", 7)
    monkeypatch.setattr(J, "MANY", many)
    rows = near_copies(11)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = J.similarity_components(docs, 3, 90, 100).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == brute(rows, 3, 90, 100)


def test_very_long_text_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(60_000))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, "w1 w2 w3")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in J.similarity_components(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert J.similarity_components(docs.where("false")).count() == 0


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 7), (5, 3), (3, 5)] + [(rnd.randrange(50, 90), 50) for _ in range(40)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and got[5] == got[3] == 3 and 7 not in got
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
