"""Bounds that must hold whatever the size: buckets, chunks, offsets and plans."""

import hashlib

from pyspark.sql import functions as F

from foldwise.operators import folds as FO
from foldwise.operators import vocab as VO
from foldwise.operators.encode import fit_target_encoding
from foldwise.operators.history import past_features
from foldwise.operators.rank import MAX_BUCKETS, default_buckets, default_hex_digits, quantile_bucket, with_range_chunk


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucket_numbers_are_bounded(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "500000")
        assert default_buckets(spark) == MAX_BUCKETS and default_hex_digits(spark) == 4
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_values_with_a_common_prefix_are_ranked_in_many_chunks(spark):
    df = spark.createDataFrame([(f"user_{i % 5000}",) for i in range(10_000)], "u string")
    chunked = with_range_chunk(df.distinct(), [F.col("u")], "c", n_chunks=16)
    sizes = [r["count"] for r in chunked.groupBy("c").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 1500
    codes = {r.value: r.code for r in VO.category_vocab([df], ["u"]).collect()}
    assert codes == {v: i for i, v in enumerate(sorted({f"user_{i}" for i in range(5000)}))}


def test_groups_of_all_sizes(spark):
    rows = [(f"g{n}", i) for n in range(1, 61) for i in range(n)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id long, g string, i long")
    got = {r.g: r.fold for r in FO.group_folds(df, 5, ["g"]).select("g", "fold").distinct().collect()}
    order = sorted(range(1, 61), key=lambda n: (-n, hashlib.md5(f"g{n}".encode()).hexdigest()))
    assert got == {f"g{n}": i % 5 for i, n in enumerate(order)}


def test_reads_do_not_double_with_each_lag(spark):
    df = spark.createDataFrame([(i, i % 7, i, float(i)) for i in range(200)], "id long, g long, s long, v double")
    scans = [plan(past_features(df, "v", ["g"], "s", aggs=[], lags=lags)).count("Scan ExistingRDD") for lags in ([1], [1, 2, 3, 4])]
    assert scans[1] <= scans[0] + 3


def test_lags_over_many_small_chunks_need_no_join_of_rows(spark):
    """Groups over many chunks, chunks shorter than the lag, ties and null order values."""
    import random

    rnd = random.Random(4)
    rows = [(i, rnd.choice([1, 1, 1, 2, 3, None]), rnd.choice([None, 1, 2, 3, 5, 8]), rnd.choice([None, float(i)])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g long, s long, v double")
    out = past_features(df, "v", ["g"], "s", aggs=[], lags=[1, 3, 9], cumcount=True, n_chunks=60)
    got = {r.id: (r.v_lag1, r.v_lag3, r.v_lag9, r.cumcount) for r in out.collect()}
    for g in (1, 2, 3):
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is None, r[2] or 0, r[0]))
        for n, r in enumerate(own):
            assert got[r[0]] == (*[own[n - L][3] if n >= L else None for L in (1, 3, 9)], n)
    assert all(got[r[0]] == (None, None, None, None) for r in rows if r[1] is None)
    joins = [plan(past_features(df, "v", ["g"], "s", aggs=[], lags=lags, n_chunks=20)).count("Join") for lags in ([1], [1, 2, 3, 4])]
    assert joins[0] == joins[1]


def test_nested_encoding_copies_no_rows(spark, monkeypatch):
    """What is written is one table as long as the train part; copies per outer fold hold keys only."""
    from foldwise.operators import encode as E

    written = []
    keep = E.materialize
    monkeypatch.setattr(E, "materialize", lambda df: written.append(keep(df)) or written[-1])
    rows = [(i, i % 2, i % 5, f"c{i % 9}", "long text " * 20) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, y int, fold int, c string, other string")
    enc = fit_target_encoding(df, ["c"], 5)
    assert [w.count() for w in written] == [500, 500] and enc.train.count() == 2000
    lines = plan(enc.rows).splitlines()
    assert not any("Generate" in x for x in lines)


def test_edges_are_broadcast_or_salted(spark, monkeypatch):
    from foldwise.operators import rank as R

    df = spark.createDataFrame([(i % 3, float(i)) for i in range(500)], "k long, v double")
    want = sorted(map(tuple, quantile_bucket(df, "v", ["k"], n_buckets=8).collect()))
    monkeypatch.setattr(R, "BROADCAST_BYTES", 0)
    salted = R.quantile_bucket(df, "v", ["k"], n_buckets=8)
    assert "_salt" in salted._jdf.queryExecution().toString()
    assert sorted(map(tuple, salted.collect())) == want


def test_null_categories_are_spread_and_get_the_prior(spark):
    rows = [(i, i % 2, i % 5, None if i % 3 else f"c{i % 4}") for i in range(600)]
    df = spark.createDataFrame(rows, "id long, y int, fold int, c string")
    enc = fit_target_encoding(df, ["c"], 5)
    got = enc.train.join(df.where("c is null").select("id"), "id").join(enc.priors, "k")
    assert got.count() > 0 and got.where("abs(c_te - prior) > 1e-12").count() == 0
    assert enc.valid(df.where("c is null")).join(enc.priors, "k").where("abs(c_te - prior) > 1e-12").count() == 0


def test_a_fit_that_does_not_converge_is_an_error(spark):
    import numpy as np
    import pytest

    from foldwise.operators import solvers as SV

    rng = np.random.default_rng(1)
    x = rng.uniform(0.05, 0.95, (400, 3))
    df = spark.createDataFrame([(i % 3, int(rng.random() < v[0]), *map(float, v)) for i, v in enumerate(x)],
                               "fold int, y int, a double, b double, c double")
    with pytest.raises(SV.NotConverged):
        SV.logistic_fit(df, ["a", "b", "c"], "y", "fold", 3, max_passes=2)
    SV.logistic_fit(df, ["a", "b", "c"], "y", "fold", 3)


def _stored_rows(spark, n=200):
    """A table of files: (id, y, fold, p)."""
    import tempfile

    path = tempfile.mkdtemp(prefix="foldwise-rows-", dir="/tmp") + "/rows"
    spark.range(n).selectExpr("id", "cast(id % 2 as int) y", "cast(id % 5 as int) fold", "(id * 37 % 101) / 101d + id % 2 * 0.3 p").write.parquet(path)
    return spark.read.parquet(path)


def test_ranks_read_the_table_once(spark):
    df = _stored_rows(spark).select("id", "y")
    folded = FO.rank_folds(df, 5, seed=42, strata="y")
    assert "FileScan" in plan(df) and "FileScan" not in plan(folded)
    assert sorted(r["count"] for r in folded.groupBy("y", "fold").count().collect()) == [20] * 10


def test_metas_share_one_reading_of_the_members(spark):
    from foldwise.plans import stack as ST

    df = _stored_rows(spark)
    long = df.selectExpr("id", "stack(2, 'a', p / 2, 'b', (id * 11 % 13) / 13d) AS (member, p)")
    res = ST.stack(long, long, df.select("id", "fold", "y"), ["a", "b"], 5, "binary", "auc", "StratifiedKFold_5")
    assert len(res.metas) == 4
    for m in res.metas.values():
        assert "FileScan" not in plan(m.oof) and m.oof.count() == 200


def test_training_reads_the_task_once(spark, monkeypatch):
    from foldwise.plans import oof as OOF
    from foldwise.plans.trainers import get_trainer
    from foldwise.spec import TaskSpec

    seen = []
    keep = OOF.prepare
    monkeypatch.setattr(OOF, "prepare", lambda s, task, *a, **kw: seen.append(plan(task)) or keep(s, task, *a, **kw))
    task = _stored_rows(spark).selectExpr("id", "y", "p", "if(id % 10 = 0, 'test', 'train') part")
    spec = TaskSpec(problem_type="binary", metric="auc", cv_strategy="StratifiedKFold", numeric_cols=("p",))
    run = OOF.run_oof(spark, task, spec, get_trainer("linear"), ["p"], max_folds=1)
    assert len(run.cv_scores) == 1 and len(seen) == 1 and "FileScan" not in seen[0]


def test_multinomial_folds_start_from_the_fit_of_all_rows(spark, monkeypatch):
    import numpy as np

    from foldwise.operators import solvers as SV

    rng = np.random.default_rng(5)
    x, fold = rng.uniform(size=(600, 4)), np.arange(600) % 4
    code = np.array([rng.choice(3, p=v[:3] / v[:3].sum()) for v in x])
    df = spark.createDataFrame([(int(f), int(c), [float(e) for e in v]) for f, c, v in zip(fold, code, x)], "fold int, code int, x array<double>")
    widths = []
    keep = SV.block_sums
    monkeypatch.setattr(SV, "block_sums", lambda d, c, k, width, **kw: widths.append(width) or keep(d, c, k, width, **kw))
    B, obj, grad, passes = SV.multinomial_fit(df, "x", 4, "code", 3, "fold", 4)
    one = 1 + 15 + 15 * 15
    alone, shared = widths.count(one), widths.count(4 * one)
    assert alone + shared == len(widths) == passes and shared < alone + 2
    for q in range(5):
        own = fold != q
        f = np.concatenate([np.ones((own.sum(), 1)), x[own]], axis=1)
        e = np.exp(f @ B[q].T)
        r = e / e.sum(axis=1, keepdims=True) - np.eye(3)[code[own]]
        g = r.T @ f + np.concatenate([np.zeros((3, 1)), B[q][:, 1:]], axis=1)
        assert np.max(np.abs(g)) < 1e-7 and np.allclose(grad[q], g.ravel(), atol=1e-8)
