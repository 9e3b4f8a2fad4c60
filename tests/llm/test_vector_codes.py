"""Vector codes against plain assignments of all parts to all entries."""

import math

import numpy as np

from foldwise.llm import vector_codes as C

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=4, entries=256, rounds=4):
    """{position of the row: (code, error)}, codebooks."""
    kept = {i: r for i, r in enumerate(rows) if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])}
    if not kept:
        return {}, None
    ints = {i: [math.floor(1024 * x) for x in np.array(r[1], dtype=np.float32).tolist()] for i, r in kept.items()}
    first = sorted(kept, key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    width = len(ints[first[0]]) // parts
    x = np.array([ints[i] for i in kept], dtype=np.int64).reshape(len(kept), parts, width)
    books = np.array([ints[i] for i in first], dtype=np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()

    def near(p):
        d = ((x[:, p, None, :] - books[p][None]) ** 2).sum(axis=2)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(rounds):
        for p in range(parts):
            at = near(p)[0]
            books[p] = [[s // (at == e).sum() for s in x[at == e, p].sum(axis=0)] if (at == e).any() else books[p][e]
                        for e in range(len(first))]
    codes, errors = zip(*[near(p) for p in range(parts)])
    return {i: ("".join(f"{c[k]:02x}" for c in codes), int(sum(e[k] for e in errors))) for k, i in enumerate(kept)}, books


def check(spark, rows, schema=SCHEMA, **sizes):
    got, books = C.vector_codes(spark.createDataFrame(rows, schema).repartition(5), **sizes)
    assert got.columns == ["vec_id", "code", "error", "label_error"]
    want, want_books = brute(rows, **sizes)
    assert (books is None and want_books is None) or np.array_equal(books, want_books)
    sums = {}
    for i, (_, e) in want.items():
        sums[rows[i][2]] = sums.get(rows[i][2], 0) + e
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=order) == sorted(
        [(rows[i][0], c, e, sums[rows[i][2]]) for i, (c, e) in want.items()], key=order)


def vectors(n, dim, seed, spread=1.0):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(6, dim))
    return (centres[rnd.integers(0, 6, n)] + spread * rnd.normal(size=(n, dim))).astype(np.float32)


def test_random_vectors_with_bad_and_repeated_rows(spark):
    x = vectors(900, 16, 1, 0.2)
    rows = [(int(k), v.tolist(), int(k) % 4 if k % 7 else None) for k, v in zip(np.random.default_rng(2).permutation(900) - 50, x)]
    rows += rows[:40] + [(rows[0][0], rows[1][1], 1)] * 3 + [(None, rows[2][1], None)]
    rows += [(1000, None, 1), (1001, [None] + rows[0][1][1:], 1), (1002, [math.nan] * 16, 1), (1003, [math.inf] * 16, None), (-99, None, 0)]
    check(spark, rows)
    check(spark, rows[:300], parts=2, entries=16, rounds=2)


def test_ties_copies_and_few_vectors(spark):
    copies = [(k, [0.5, -0.25, 0.0, 1.0], 1) for k in range(1500)]
    check(spark, copies + [(k, [float(k % 3), 0.0, 0.0, -1.0], None) for k in range(2000, 2030)])
    check(spark, [(3, [0.1] * 8, None)])
    check(spark, [(k, [float(k % 5), float(k % 2)] * 4, k % 2) for k in range(60)], entries=5)


def test_no_vectors_and_clashing_columns(spark):
    check(spark, [])
    check(spark, [(1, None, 2)])
    out, books = C.vector_codes(spark.createDataFrame([(1, [1.0] * 4, 2, "x", 5, 6)], SCHEMA + ", row string, part int, _label int"))
    assert [tuple(r) for r in out.collect()] == [(1, "00000000", 0, 0)] and books.shape == (4, 1, 1)


def test_other_lengths_go(spark):
    rows = [(1, [1.0] * 4, 2), (2, [1.0] * 8, 2), (0, [], 2), (-1, [1.0] * 3, 2), (5, [2.0] * 4, 2)]
    out, _ = C.vector_codes(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r.vec_id for r in out.collect()) == [1, 5]


def test_shortlists_hold_every_nearest_entry_and_save_work():
    x = np.floor(1024 * vectors(4000, 4, 3, 0.15)).astype(np.int64)
    entries = np.unique(x[:200], axis=0)
    order = np.argsort(C.hilbert_keys(x, x.min(axis=0), x.max(axis=0)))
    tried = 0
    for a in range(0, len(x), 100):
        block = x[order[a:a + 100]]
        near = C.shortlist(block.min(axis=0), block.max(axis=0), entries)
        at, d = C.nearest(block, entries)
        assert np.isin(at, near).all()
        again, same = C.nearest(block, entries[near])
        assert np.array_equal(near[again], at) and np.array_equal(same, d)
        tried += len(near)
    assert tried < 0.5 * 40 * len(entries)


def test_hilbert_curve_visits_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 2, indexing="ij"), axis=-1).reshape(-1, 2)
    # 16 bits a dimension over a box of 8 x 8: cells keep the order of the curve
    at = grid[np.argsort(C.hilbert_keys(grid, np.zeros(2, dtype=np.int64), np.full(2, 7)))]
    assert (np.abs(np.diff(at, axis=0)).sum(axis=1) == 1).all()


def test_wide_integers_are_exact():
    rnd = np.random.default_rng(4)
    x, e = (rnd.integers(-C.LIMIT + 1, C.LIMIT, (n, 5)) for n in (150, 30))
    at, d = C.nearest(x, e)
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in e] for p in x]
    assert d.tolist() == [min(w) for w in want] and at.tolist() == [w.index(min(w)) for w in want]
