"""The training job end to end: names, stored split, sinks, log, stacking of stored runs."""

from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from foldwise.operators import integrity as IG
from foldwise.operators import runs as RU
from foldwise.operators.members import member_matrix
from foldwise.plans import job as J
from foldwise.plans import oof as OOF
from foldwise.plans import stack as ST
from foldwise.plans import trainers as TR
from foldwise.plans.trainers import get_trainer
from foldwise.session import scratch_path
from foldwise.sources import tasks as T


@pytest.fixture(scope="module")
def named(spark):
    t = T.with_planted_features(T.syn_task(spark, SF_SMALL)).withColumnsRenamed({"id": "row_key", "y": "target"})
    return t, replace(T.SPECS["syn"], id_col="row_key", target_col="target", te_cols=("user_id",), drop_cols=("ts",))


def test_two_runs_and_a_stack_of_a_stack(spark, named):
    t, spec = named
    store = scratch_path(spark, "job")
    template = t.where("part = 'test'").select("row_key").withColumn("target", F.lit(0.0))
    a = J.train_job(spark, t, spec, get_trainer("linear"), store, "a", template=template)
    b = J.train_job(spark, t, replace(spec, model_seed=7), get_trainer("rf", numTrees=5), store, "b", keep_models=True)
    assert IG.read_split(spark, f"{store}/splits", IG.split_regime(t.where("part = 'train'"), spec)).count() == a.run.oof.count()
    logs = RU.read_raw_logs(spark, a.path("logs"))
    assert {r.exp_id: r.cv_strategy for r in logs.collect()} == {"a": "StratifiedKFold_5", "b": "StratifiedKFold_5"}
    assert all(len(r.timestamp) == 19 for r in logs.collect())
    assert spark.read.parquet(a.path("submission")).count() == template.count()
    assert b.run.features == a.run.features == ("value", "s_a", "s_n", "user_id_te")

    train = t.where("part = 'train'").select(F.col("row_key").alias("id"), F.col("target").alias("y"))
    ids = t.where("part = 'test'").select(F.col("row_key").alias("id"))
    inner = replace(spec, id_col="id", target_col="y")
    split = IG.get_or_create_split(spark, t.where("part = 'train'"), spec, f"{store}/splits").withColumnRenamed("row_key", "id")
    folded = train.join(split, "id")
    oof, test = J.members_of(spark, store, ["a", "b"], "target", "row_key")
    s1 = ST.stack_job(spark, oof, test, folded, ids, ["a", "b"], inner, raw_logs=logs)
    assert s1.result.best.oof_score >= dict(s1.result.scores)["equal"]
    J.record_stack(spark, s1, store, "stack_1")
    oof1 = spark.read.parquet(f"{store}/oof/stack_1").select(F.lit("stack_1").alias("member"), "id", F.col("oof").alias("p"))
    test1 = spark.read.parquet(f"{store}/submission/stack_1").select(F.lit("stack_1").alias("member"), "id", F.col("y").alias("p"))
    logs = RU.read_raw_logs(spark, a.path("logs"))
    s2 = ST.stack_job(spark, oof.unionByName(oof1), test.unionByName(test1), folded, ids, ["a", "stack_1"], inner, raw_logs=logs)
    assert s2.oof_table.count() == folded.count()
    with pytest.raises(ValueError, match="no log"):
        ST.stack_job(spark, oof, test, folded, ids, ["a", "b"], inner, raw_logs=logs.where("exp_id = 'a'"))
    with pytest.raises(ValueError, match="folds"):
        ST.stack_job(spark, oof, test, folded.withColumn("fold", F.least("fold", F.lit(2))), ids, ["a", "b"], inner, raw_logs=logs)


def test_screening_run_leaves_only_a_log(spark, named):
    t, spec = named
    store = scratch_path(spark, "job")
    job = J.train_job(spark, t, replace(spec, te_cols=(), drop_cols=("ts", "user_id")), get_trainer("linear"), store, "s", max_folds=2)
    assert [r.cv_strategy for r in RU.read_raw_logs(spark, job.path("logs")).collect()] == ["StratifiedKFold_5_partial2"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(job.path("oof"))


def test_undeclared_text_column_is_an_error(spark, named):
    t, spec = named
    with pytest.raises(ValueError, match="note"):
        J.train_job(spark, t.withColumn("note", F.lit("x")), spec, get_trainer("linear"), scratch_path(spark, "job"), "x")


def test_features_called_id_and_y(spark, named):
    t, spec = named
    t = t.withColumnsRenamed({"s_a": "id", "s_n": "y"})
    run = OOF.run_oof(spark, t, replace(spec, te_cols=()), get_trainer("linear"), ["id", "y"], max_folds=1)
    assert run.cv_scores[0] > 0.8


def test_boosted_trees_of_several_classes(spark):
    t, spec = T.load_task(spark, SF_SMALL, "mc")
    run = OOF.run_oof(spark, t, spec, get_trainer("gbt", maxIter=2, maxDepth=2), ["o_totalprice"], categorical=["o_orderstatus"],
                      max_folds=1)
    assert len(run.cv_scores) == 1 and run.best_iters == [2]


def test_best_round_and_patience():
    nan = float("nan")
    assert TR.best_round([5, 4, 3, 3.5, 2], 2) == 5
    assert TR.best_round([5, 4, 3, 3.5, 3.2, 2], 2) == 3    # two rounds without a better loss end the search
    assert TR.best_round([1, 2, 3], 50) == 1 and TR.best_round([3, 2, 2], 50) == 2
    assert TR.best_round([nan, nan], 1) == 2 and TR.best_round([nan, 4, 5], 5) == 2


@pytest.mark.parametrize("kind", ["binary", "regression", "multiclass"])
def test_models_end_at_their_best_round(spark, kind):
    """The kept rounds are those up to the least validation loss, and the log has their number."""
    from pyspark.ml.feature import VectorAssembler

    trainer = get_trainer("gbt", maxIter=12, maxDepth=5, stepSize=0.9, patience=12)
    full = get_trainer("gbt", maxIter=12, maxDepth=5, stepSize=0.9)
    u = T.syn_task(spark, SF_SMALL).select("id", "value", "y", (F.col("id") % 3 == 0).alias("_is_val")).where("value IS NOT NULL")
    label = {"binary": F.col("y"), "regression": F.col("y") * 2.5 + F.col("value") % 1, "multiclass": F.col("id") % 7 % 3}[kind]
    df = VectorAssembler(inputCols=["value"], outputCol="features").transform(u.withColumn("label", label.cast("double"))).cache()
    model = trainer.fit(df, kind, validation_col="_is_val")
    whole = full.fit(df.where("NOT _is_val"), kind)
    pairs = [(model[c], whole[c], c) for c in model] if kind == "multiclass" else [(model, whole, None)]
    for short, long, c in pairs:
        held = df.where("_is_val") if c is None else df.where("_is_val").withColumn("label", (F.col("label") == c).cast("double"))
        losses = long.evaluateEachIteration(held, "squared") if kind == "regression" else long.evaluateEachIteration(held)
        assert short.getNumTrees == min(range(12), key=lambda i: losses[i]) + 1
        kept = short.evaluateEachIteration(held, "squared") if kind == "regression" else short.evaluateEachIteration(held)
        assert kept[-1] == pytest.approx(min(losses), rel=1e-9)
    assert trainer.metadata(model)["best_iter"] == max(s.getNumTrees for s, _, _ in pairs)
    if kind != "multiclass":
        assert model.getNumTrees < 12      # the step is so large that later rounds do harm
    p = trainer.predict(model, df, kind, 3)
    assert p.select("probs" if kind == "multiclass" else "p").dropna().count() == df.count()


def test_logs_hold_the_models_iterations(spark, named):
    t, spec = named
    spec, store = replace(spec, te_cols=(), drop_cols=("ts", "user_id")), scratch_path(spark, "job")
    job = J.train_job(spark, t, spec, get_trainer("gbt", maxIter=3, maxDepth=2), store, "few", early_stopping=True, max_folds=2)
    logs = RU.read_raw_logs(spark, job.path("logs"))
    assert logs.first().best_iters == job.run.best_iters == [m.getNumTrees for m in job.run.models]
    assert RU.unconverged_folds(logs, 3).count() == sum(b >= 2 for b in job.run.best_iters) > 0
    assert RU.unconverged_folds(logs, 1000).count() == 0


def test_sweep_shares_split_and_encoding(spark, named, monkeypatch):
    t, spec = named
    store, made = scratch_path(spark, "sweep"), []
    fit = OOF.fit_target_encoding
    monkeypatch.setattr(OOF, "fit_target_encoding", lambda *a, **k: made.append(1) or fit(*a, **k))
    settings = {f"s{i}": get_trainer("linear", regParam=reg) for i, reg in enumerate((0.0, 0.01, 10.0))}
    jobs = J.sweep(spark, t, spec, settings, store, parallel=3)
    assert len(made) == 1 and len(list((Path(store.removeprefix("file:")) / "splits/manifests").iterdir())) == 1
    logs = {r.exp_id: r for r in RU.read_raw_logs(spark, jobs["s0"].path("logs")).collect()}
    assert set(logs) == set(settings)
    alone = J.train_job(spark, t, spec, settings["s1"], scratch_path(spark, "job"), "alone")
    assert alone.run.cv_scores == pytest.approx(jobs["s1"].run.cv_scores, abs=1e-9)
    assert logs["s0"].cv_scores != logs["s2"].cv_scores
    with pytest.raises(ValueError, match="already"):      # before anything is trained
        J.sweep(spark, t, spec, {"new": settings["s0"], "s2": settings["s2"]}, store)
    assert "new" not in {r.exp_id for r in RU.read_raw_logs(spark, jobs["s0"].path("logs")).collect()}


def test_fits_run_at_the_same_time(spark):
    import threading
    import time

    together, most, lock = [0], [0], threading.Lock()

    def task(i):
        with lock:
            together[0] += 1
            most[0] = max(most[0], together[0])
        time.sleep(0.2)
        with lock:
            together[0] -= 1
        return i, spark.sparkContext.getLocalProperty("spark.scheduler.pool")

    spark.sparkContext.setLocalProperty("own.mark", "x")
    out = OOF.run_side_by_side([lambda i=i: task(i) for i in range(6)], spark, parallel=3)
    assert [i for i, _ in out] == list(range(6)) and most[0] == 3
    assert {p for _, p in out} == {"fit-0", "fit-1", "fit-2"}


def test_stored_matrix_moves_no_row(spark, named):
    t, spec = named
    spec, store = replace(spec, te_cols=(), drop_cols=("ts", "user_id")), scratch_path(spark, "job")
    settings = {f"m{i}": get_trainer("linear", regParam=r) for i, r in enumerate((0.0, 0.1, 1.0))}
    J.sweep(spark, t, spec, settings, store)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        m = J.stored_matrix(spark, store, list(settings), "row_key")
        assert "Exchange" not in m._jdf.queryExecution().executedPlan().toString()
        oof, _ = J.members_of(spark, store, list(settings), "target", "row_key")
        assert m.exceptAll(member_matrix(oof, list(settings))).isEmpty() and m.count() == t.where("part = 'train'").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_template_with_a_repeated_key(spark, tmp_path):
    (tmp_path / "t.csv").write_text("row_key,target\n1,0\n1,0\n")
    with pytest.raises(ValueError, match="repeats"):
        OOF.read_template(spark, str(tmp_path / "t.csv"), "row_key")


def test_validation_rows_do_not_reach_their_model(spark, named):
    """Flipping the targets of fold 0 moves no prediction of fold 0."""
    t, spec = named
    tr = t.where("part = 'train'")
    split = IG.get_or_create_split(spark, tr, spec, scratch_path(spark, "splits"))
    flipped = t.join(split, "row_key", "left").withColumn(
        "target", F.when(F.col("fold") == 0, 1 - F.col("target")).otherwise(F.col("target"))).drop("fold")
    a = OOF.run_oof(spark, t, spec, get_trainer("linear"), ["value", "s_a"], split=split).oof
    b = OOF.run_oof(spark, flipped, spec, get_trainer("linear"), ["value", "s_a"], split=split).oof
    moved = a.join(b.select("id", F.col("p").alias("q")), "id").withColumn("d", F.abs(F.col("p") - F.col("q")))
    by_fold = {r.fold: r.m for r in moved.groupBy("fold").agg(F.max("d").alias("m")).collect()}
    assert by_fold[0] < 1e-9 and all(by_fold[k] > 1e-6 for k in range(1, 5))
