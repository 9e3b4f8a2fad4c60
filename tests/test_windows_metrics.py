"""Past-only windows (hot groups, nulls, ties) and metric edge cases."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from foldwise.operators import metrics as M
from foldwise.operators.history import past_features


def _plain(df, keys, seq):
    w = Window.partitionBy(*keys).orderBy(F.col(seq).asc_nulls_last(), "id").rowsBetween(Window.unboundedPreceding, -1)
    return df.select("id", F.avg("v").over(w).alias("m"), F.stddev_samp("v").over(w).alias("s"),
                     F.max("v").over(w).alias("mx"), F.sum("v").over(w).alias("sm"))


def test_hot_group_split_into_chunks_equals_plain_window(spark):
    # one group holds most rows: it must be cut into several chunks and still give the plain result
    rows = [(i, 0 if i % 10 else (i % 7) + 1, float(i % 13), (i * 7919) % 1000) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g long, v double, seq long")
    got = past_features(df, "v", ["g"], "seq", n_chunks=16).select(
        "id", F.col("v_past_mean").alias("m"), F.col("v_past_std").alias("s"), F.col("v_past_max").alias("mx"),
        F.col("v_past_sum").alias("sm"))
    want = _plain(df, ["g"], "seq")
    g = {r["id"]: r for r in got.collect()}
    assert len(g) == 3000
    for r in want.collect():
        o = g[r["id"]]
        for c in ("m", "s", "mx", "sm"):
            if r[c] is None:
                assert o[c] is None
            else:
                assert abs(o[c] - r[c]) < 1e-9 * max(1.0, abs(r[c]))


def test_nulls_ties_and_short_history(spark):
    rows = [(1, 1, 1.0, 1), (2, 1, None, 2), (3, 1, 3.0, 2), (4, 1, 5.0, None), (5, None, 9.0, 1), (6, 2, 4.0, 1)]
    df = spark.createDataFrame(rows, "id long, g long, v double, seq long")
    out = {r["id"]: r for r in past_features(df, "v", ["g"], "seq", lags=[1], cumcount=True).collect()}
    assert out[1]["v_past_mean"] is None and out[1]["cumcount"] == 0
    assert out[2]["v_past_mean"] == 1.0 and out[2]["v_past_std"] is None       # history of length 1
    assert out[3]["v_past_mean"] == 1.0                                         # null value skipped; tie by id
    assert out[4]["v_past_mean"] == 2.0 and out[4]["cumcount"] == 3             # null sequence ordered last
    assert out[4]["v_lag1"] == 3.0
    assert out[5]["v_past_mean"] is None and out[5]["cumcount"] is None         # null group key
    assert out[6]["v_past_sum"] is None


def test_auc_single_class_is_null_and_ties_count_half(spark):
    df = spark.createDataFrame([(0, 1, 0.3), (0, 1, 0.4), (1, 0, 0.5), (1, 1, 0.5), (1, 0, 0.2), (1, 1, 0.9)],
                               "fold int, y int, p double")
    r = {x["fold"]: x["auc"] for x in M.auc(df, ["fold"]).collect()}
    assert r[0] is None
    # fold 1: pos {0.5, 0.9}, neg {0.5, 0.2}: pairs (0.5>0.2)=1, (0.5=0.5)=0.5, (0.9>*)=2 -> 3.5/4
    assert abs(r[1] - 0.875) < 1e-12


def test_hard_labels(spark):
    df = spark.createDataFrame([(0, 0.5, [0.2, 0.4, 0.4], 1)], "y int, p double, probs array<double>, code int")
    assert M.accuracy(df, [], "y", "p").first()[0] == 1.0          # 0.5 -> label 0
    assert M.accuracy(df, [], "code", "probs", multiclass=True).first()[0] == 1.0  # first maximum wins


def test_metrics_invariant_to_partitioning(spark):
    rows = [(i % 3, i % 2, ((i * 37) % 101) / 101.0) for i in range(2000)]
    df = spark.createDataFrame(rows, "fold int, y int, p double")
    a = sorted(M.auc(df.repartition(1), ["fold"]).collect())
    b = sorted(M.auc(df.repartition(17), ["fold"]).collect())
    assert [(x[0], round(x[1], 12)) for x in a] == [(x[0], round(x[1], 12)) for x in b]
