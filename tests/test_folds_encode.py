"""Fold balance, group integrity, invariance and target-encoding leak tests."""

from pyspark.sql import functions as F

from conftest import SF_MID
from foldwise.operators import folds as FO
from foldwise.operators.encode import fit_target_encoding
from foldwise.sources import tasks as T


def test_stratified_balance_and_partition(spark):
    t, spec = T.load_task(spark, SF_MID, "bin")
    f = FO.assign_folds(T.train_rows(t), spec)
    per = f.groupBy("y", "fold").count().collect()
    for y in (0, 1):
        counts = [r["count"] for r in per if r["y"] == y]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1
    assert f.count() == T.train_rows(t).count() == f.select("id").distinct().count()


def test_group_folds_never_split_a_group(spark):
    t, spec = T.load_task(spark, SF_MID, "grp")
    f = FO.assign_folds(T.train_rows(t), spec)
    assert f.groupBy("user_id").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0


def test_null_group_key_is_one_shared_group(spark):
    df = spark.createDataFrame([(i, None if i < 3 else i % 4) for i in range(20)], "id long, g long")
    f = FO.group_folds(df, 3, ["g"])
    assert f.where("g IS NULL").select("fold").distinct().count() == 1
    assert f.count() == 20


def test_folds_do_not_depend_on_partitioning(spark):
    t, spec = T.load_task(spark, SF_MID, "bin")
    tr = T.train_rows(t)
    a = FO.assign_folds(tr.repartition(1), spec).select("id", "fold")
    b = FO.assign_folds(tr.repartition(17), spec).select("id", "fold")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def _enc(spark, folded, smoothing=20.0):
    return fit_target_encoding(folded, ["c"], 5, smoothing=smoothing)


def test_validation_encoding_ignores_own_fold_target(spark):
    """Permuting the targets of validation fold 0 leaves its encodings unchanged."""
    t, spec = T.load_task(spark, SF_MID, "bin")
    f = FO.assign_folds(T.train_rows(t), spec).withColumnRenamed("user_id", "c")
    flipped = f.withColumn("y", F.when(F.col("fold") == 0, 1 - F.col("y")).otherwise(F.col("y")))
    a = _enc(spark, f).valid(f).where("fold = 0").select("id", "c_te")
    b = _enc(spark, flipped).valid(f).where("fold = 0").select("id", "c_te")
    assert a.exceptAll(b).count() == 0


def test_own_target_never_reaches_own_train_encoding(spark):
    """With smoothing 0 (no prior term) a row's nested encodings do not move when its own target does."""
    rows = [(i, float(i % 2), i % 5, "a" if i % 3 else "b") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, y double, fold int, c string")
    target_id = 7
    df2 = df.withColumn("y", F.when(F.col("id") == target_id, F.lit(5.0)).otherwise(F.col("y")))
    e1 = fit_target_encoding(df, ["c"], 5, smoothing=0.0, problem_type="regression")
    e2 = fit_target_encoding(df2, ["c"], 5, smoothing=0.0, problem_type="regression")
    a = {r["k"]: r["c_te"] for r in e1.train.where(f"id = {target_id}").collect()}
    b = {r["k"]: r["c_te"] for r in e2.train.where(f"id = {target_id}").collect()}
    assert a.keys() == b.keys() and len(a) == 4
    for k in a:
        assert abs(a[k] - b[k]) < 1e-12
    # while the validation map of the other folds does see the change
    v1 = e1.maps["c"].where("k != 2").agg(F.sum("enc")).first()[0]
    v2 = e2.maps["c"].where("k != 2").agg(F.sum("enc")).first()[0]
    assert v1 != v2


def test_null_unseen_and_smoothing_zero(spark):
    rows = [(1, 1, 0, "a"), (2, 0, 0, "b"), (3, 1, 1, "a"), (4, 0, 1, None), (5, 1, 0, "z"), (6, 0, 1, "b")]
    df = spark.createDataFrame(rows, "id long, y int, fold int, c string")
    enc = fit_target_encoding(df, ["c"], 2, smoothing=0.0, n_inner=2)
    tr = enc.train.join(enc.priors, "k").collect()
    for r in tr:
        assert r["c_te"] is not None
    test = spark.createDataFrame([(10, "never"), (11, None)], "id long, c string")
    out = enc.test(test).join(enc.priors, "k").collect()
    assert all(abs(r["c_te"] - r["prior"]) < 1e-15 for r in out)


def test_group_aware_inner_folds_keep_groups_together(spark):
    rows = [(i, i % 2, i % 3, i % 7, f"c{i % 4}") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, y int, fold int, g long, c string")
    enc = fit_target_encoding(df, ["c"], 3, group_keys=["g"])
    j = enc.train.join(df.select("id", "g"), "id")
    assert j.groupBy("k", "g").agg(F.countDistinct("j").alias("n")).where("n > 1").count() == 0


def test_nested_encoding_does_not_depend_on_partitioning(spark):
    t, spec = T.load_task(spark, SF_MID, "bin")
    tr = T.train_rows(t).select("id", "y", "user_id")
    outs = []
    for n in (1, 17):
        f = FO.assign_folds(tr.repartition(n), spec)
        e = fit_target_encoding(f, ["user_id"], 5)
        outs.append(e.train.select("id", "k", F.round("user_id_te", 12).alias("te")))
    assert outs[0].exceptAll(outs[1]).count() == 0 and outs[1].exceptAll(outs[0]).count() == 0
