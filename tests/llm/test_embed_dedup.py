"""Embedding near-dedup against all cosines."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foldwise.llm import embed_dedup as M
from foldwise.llm.queries import op10_embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=M.COSINE):
    """{id: (n_links, links)} by all pairs."""
    ok = {}
    for i, (v, x, label) in enumerate(rows):
        if x and label is not None and None not in x and np.isfinite(x).all() and np.any(np.array(x) != 0):
            a = np.array(x, dtype=np.float32).astype(float)
            ok[i] = a / np.abs(a).max() / np.linalg.norm(a / np.abs(a).max())
    links = {i: set() for i in range(len(rows))}
    for i in ok:
        for j in ok:
            if i < j and rows[i][2] == rows[j][2] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= cosine:
                links[i].add(j)
                links[j].add(i)
    return links


def test_query_links_no_pair_below_the_threshold(spark):
    path = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    links = brute(rows)
    out = {r.vec_id: r for r in op10_embedding_dedup(spark, path).collect()}
    assert len(out) == len(rows)
    assert all(out[v].n_links <= len(links[i]) for i, (v, *_) in enumerate(rows))
    assert all(r.kept == (r.vec_id == r.component_id) and r.component_id <= r.vec_id for r in out.values())


def test_recall_near_the_threshold(spark):
    rng = np.random.default_rng(4)
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").limit(500).collect()]
    for v, x, label in list(rows):
        x = np.array(x) / np.linalg.norm(x)
        noise = rng.normal(size=len(x))
        noise -= (noise @ x) * x
        c = rng.uniform(0.975, 0.99)
        rows.append((10_000 + v, (c * x + np.sqrt(1 - c * c) * noise / np.linalg.norm(noise)).tolist(), label))
    links = brute(rows)
    out = {r.vec_id: r for r in M.near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = sum(map(len, links.values()))
    assert want > 300
    assert sum(out[v].n_links for v, *_ in rows) >= 0.95 * want
    assert all(out[v].n_links <= len(links[i]) for i, (v, *_) in enumerate(rows))


def test_hot_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 30)
    rng = np.random.default_rng(1)
    base = rng.normal(size=16)
    rows = [(i, (base + rng.normal(0, 0.05, 16)).tolist(), 1) for i in range(200)]
    rows += [(1000 + i, base.tolist(), 1) for i in range(50)] + [(2000 + i, rng.normal(size=16).tolist(), 1) for i in range(50)]
    links = brute(rows)
    out = {r.vec_id: r for r in M.near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = sum(map(len, links.values()))
    assert sum(r.n_links for r in out.values()) >= 0.97 * want
    assert all(out[v].n_links <= len(links[i]) for i, (v, *_) in enumerate(rows))
    assert all(out[2000 + i].n_links == 0 for i in range(50))


def test_groups_sorted_together_count_as_alone():
    rng = np.random.default_rng(6)
    size = np.array([1, 5, 48, 2, 17])
    x = rng.normal(0, 2, (size.sum(), 9)).astype(np.float32)
    got = M.group_counts(x, size, 1.0)
    i, j = M.pairs_of_groups(np.cumsum(size) - size, size)
    assert (got == (np.abs(x[i].astype(float) - x[j]) <= 1.0).sum(axis=1)).all()


def test_labels_of_any_width_keep_apart(spark):
    rows = [(k, [1.0, 2.0, 3.0], label) for k, label in enumerate((1, 1 + 2**32, -1, 2**32 - 1, 1))]
    out = {r.vec_id: (r.n_links, r.component_id) for r in M.near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label long")).collect()}
    assert out == {0: (1, 0), 1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 0)}


def test_lines_are_sorted_on_the_given_vectors(spark, monkeypatch):
    """Every compared pair of sf0.01 comes out of sorted lines, of small cells and of large ones."""
    from foldwise.llm.common import table

    rows = table(spark, "/root/testdata/sf0.01", "embeddings").select(F.col("vec_id").alias("v"), F.col("embedding").cast("array<double>").alias("x"),
                                                                     F.col("label").cast("long").alias("label"))
    found = M._vectors(rows, M.COSINE).toPandas()
    cells = {}
    for c, unit, lines, own in found.itertuples(index=False):
        for t, cell in enumerate(own):
            cells.setdefault(cell, []).append((c, unit, lines, own, t))
    shared = [(cell, m) for cell, m in cells.items() if len(m) > 1]
    assert shared
    data = [{"cell": cell, "i": 0, "j": 0, "t": t, "block": 0, "c": c, "weight": 1, "lines": lines, "cells": own, "unit": unit}
            for cell, m in sorted(shared) for c, unit, lines, own, t in m]
    counted, sort = [], M.group_counts
    monkeypatch.setattr(M, "group_counts", lambda x, size, window: counted.append(size.sum()) or sort(x, size, window))
    told = [r for b in M._search(pa.Table.from_pylist(data), M.COSINE) for r in b.to_pylist()]
    assert sum(counted) == len(data) > 0 and all(r["links"] > 0 for r in told)


def test_window_counts_match_their_definition():
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(60, 8)).round(1), rng.normal(size=(20, 8)).round(1)
    want = (np.abs(q[:, None] - x[None]) <= 0.5 + 1e-9).sum(axis=2)
    assert (M.window_counts(x, q, 0.5 + 1e-9) == want).all()


def test_calibration():
    rng = np.random.default_rng(7)
    p = (np.abs(rng.normal(size=(20_000, M.LINES))) <= M.WINDOW).sum(axis=1)
    assert np.mean(p >= M.collision_bound()) > M.COUNT_RECALL - 0.005
    assert M.cell_recall() * M.COUNT_RECALL > 0.95


@pytest.mark.parametrize("kind", ["embedding array<float>", "embedding array<double>"])
def test_edges(spark, kind):
    nan, inf = float("nan"), float("inf")
    x = [1.0, 2.0, 0.5]
    rows = [(1, x, 1), (2, x, 1), (3, x, 2), (4, x, None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, nan, 1.0], 1),
            (9, [inf, 1.0, 1.0], 1), (10, [1.0, None, 1.0], 1), (11, [2.0, 4.0, 1.0], 1), (12, [*x, 0.0], 1), (13, [-1.0, -2.0, -0.5], 1),
            (14, [1e-30, 2e-30, 5e-31], 1), (None, x, 2), (2, x, 1)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], f"vec_id long, {kind}, label int, n_links int")
    out = M.near_dedup(docs).collect()
    assert len(out) == len(rows)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out}
    assert got[1] == (4, 1, True) and got[2] == (4, 1, False) and got[11] == (4, 1, False) and got[14] == (4, 1, False)
    assert got[3] == (1, 3, True) and got[None] == (1, 3, False)
    for i in (4, 5, 6, 7, 8, 9, 10, 12, 13):
        assert got[i] == (0, i, True)
    assert M.near_dedup(docs.where("false")).count() == 0
