"""Ordered scans and level offsets: values, ties over task boundaries, plans."""

import random

import pytest
from pyspark.sql import functions as F

from foldwise.operators import blend as BL
from foldwise.operators import folds as FO
from foldwise.operators import metrics as M
from foldwise.operators import rank as RK
from foldwise.operators import scan as SC


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_with_ties(seed, n, values):
    rnd = random.Random(seed)
    return [(i, rnd.choice(["a", "b", None]), rnd.randint(0, 2), rnd.randint(0, 1), rnd.choice(values)) for i in range(n)]


def auc_of(rows):
    pos, neg = [r[4] for r in rows if r[3]], [r[4] for r in rows if not r[3]]
    if not pos or not neg:
        return None
    key = lambda x: (x is not None, x or 0.0)
    return sum((key(a) > key(b)) + 0.5 * (key(a) == key(b)) for a in pos for b in neg) / (len(pos) * len(neg))


SCHEMA = "id long, m string, fold int, y int, p double"


@pytest.fixture
def small_batches(spark):
    """Few rows a batch and many ranges: runs and ties go over batches and tasks."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions",
                                          "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("values", [[0.5], [0.1, 0.5, 0.9], [i / 40 for i in range(40)] + [None], [-0.0, 0.0, 1e300, -1e300]])
def test_auc_against_all_pairs(spark, small_batches, values):
    rows = rows_with_ties(1, 500, values)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    for keys, of in ((["m", "fold"], lambda r: (r[1], r[2])), (["fold"], lambda r: (r[2],)), ([], lambda r: ())):
        groups = {}
        for r in rows:
            groups.setdefault(of(r), []).append(r)
        got = {tuple(r)[:len(keys)]: r.auc for r in M.auc(df, keys).collect()}
        assert set(got) == set(groups)
        for k, g in groups.items():
            assert got[k] == pytest.approx(auc_of(g), abs=1e-12)


def test_groups_of_one_class_are_flagged(spark):
    df = spark.createDataFrame([(1, "a", 0, 1, 0.5), (2, "a", 0, 1, 0.6), (3, "b", 0, 1, 0.5), (4, "b", 0, 0, 0.1)], SCHEMA)
    got = {r.m: (r.auc, r.degenerate) for r in M.auc(df, ["m"], degenerate="degenerate").collect()}
    assert got == {"a": (None, True), "b": (1.0, False)}
    assert M.auc(df.where("false"), ["m"]).collect() == []


@pytest.mark.parametrize("limit", [SC.BROADCAST_BYTES, 0])
@pytest.mark.parametrize("values", [[0.5], [0.1, 0.5, 0.9], [i / 40 for i in range(40)]])
def test_average_ranks_against_sorting(spark, small_batches, monkeypatch, values, limit):
    monkeypatch.setattr(SC, "BROADCAST_BYTES", limit)
    rows = rows_with_ties(2, 400, values)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.id: r["rank"] for r in BL.average_rank(df, ["m", "fold"]).collect()}
    assert len(got) == len(rows)
    for i, m, fold, _, p in rows:
        peers = [r[4] for r in rows if (r[1], r[2]) == (m, fold)]
        assert got[i] == sum(x < p for x in peers) + (sum(x == p for x in peers) + 1) / 2
    one = {r.id: r["rank"] for r in BL.average_rank(df, []).collect()}
    for i, _, _, _, p in rows[:50]:
        assert one[i] == sum(r[4] < p for r in rows) + (sum(r[4] == p for r in rows) + 1) / 2


def test_a_common_value_is_spread_over_tasks(spark, small_batches):
    rows = [(i, "a", 0, i % 2, 0.5) for i in range(3000)]
    ordered = SC.by_range(spark.createDataFrame(rows, SCHEMA), ["m"], "p").groupBy(F.spark_partition_id()).count().collect()
    assert len(ordered) == 13 and max(r["count"] for r in ordered) < 3000 / 4


def test_predictions_are_exchanged_once(spark):
    df = spark.createDataFrame(rows_with_ties(3, 200, [0.1, 0.2, 0.7]), SCHEMA)
    lines = plan_of(M.auc(df, ["m", "fold"])).splitlines()
    ranges = [x for x in lines if "Exchange rangepartitioning" in x]
    assert len(ranges) == 1 and "p#" in ranges[0]
    # the exchange of the predictions lies below the scan; above it there are only segments
    scan = next(i for i, x in enumerate(lines) if "MapInArrow" in x)
    below = [x for x in lines[scan:] if "Exchange" in x and "Reused" not in x]
    assert len(below) == 1
    # the ranked rows are read from where the range exchange left them: only segments are exchanged
    ranks = [x for x in plan_of(BL.average_rank(df, ["m"])).splitlines() if "Exchange" in x]
    assert len(ranks) == 2 and "BroadcastExchange" in ranks[0] and "hashpartitioning(m" in ranks[1] and "task#" in ranks[1]


def test_offsets_of_many_classes_by_levels(spark):
    """10,000 classes: no single task orders more than the classes; their prefixes are ordered within each."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(60_000).select("id", (F.xxhash64("id") % 10_000).alias("y"))
        out = FO.rank_folds(df, 5, seed=42, strata="y", digits=4)
        plan = plan_of(out).splitlines()
        for i, line in enumerate(plan):
            if "SinglePartition" in line:
                keys = next(x for x in plan[i:] if "HashAggregate" in x)
                assert "_hb" not in keys.split("functions=")[0]
        assert any("SinglePartition" in x for x in plan)
        seen = {r.id: r.fold for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    import hashlib

    rows = sorted((r.y, hashlib.md5(f"{r.id}:42".encode()).hexdigest(), r.id) for r in df.collect())
    assert all(seen[i] == k % 5 for k, (_, _, i) in enumerate(rows))


def test_row_numbers_and_sums_with_null_levels(spark):
    rows = [(i, i % 3 if i % 7 else None, f"{i % 4}", i) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, c int, b string, w long")
    got = {r.id: (r.rn, r.before_w) for r in RK.prefix_sums(RK.global_row_number(df, ["c", "b"], ["id"]), ["w"], ["c", "b"], ["id"]).collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[0]))
    total = 0
    for n, r in enumerate(order):
        assert got[r[0]] == (n + 1, total)
        total += r[3]
