"""Run logs (corrupt files, regimes), split store, alignment, spec preconditions."""

import json
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from foldwise.operators import integrity as IG
from foldwise.operators import runs as RU
from foldwise.operators.members import alignment_report, check_alignment
from foldwise.session import scratch_path
from foldwise.sources import stored
from foldwise.sources import tasks as T
from foldwise.spec import TaskSpec


def _write(dirpath, name, obj):
    Path(dirpath, name).write_text(obj if isinstance(obj, str) else json.dumps(obj, indent=2))


def test_logs_skip_unreadable_and_fallback_regimes(spark):
    d = tempfile.mkdtemp(prefix="foldwise-logs-", dir="/tmp")
    _write(d, "a.json", {"exp_id": "a", "model": "lgbm", "cv_strategy": "StratifiedKFold_5", "cv_scores": [0.8, 0.82],
                         "cv_mean": 0.81, "features": ["x"], "notes": "n" * 80})
    _write(d, "b.json", {"exp_id": "b", "model": "LGBM", "cv_strategy": "StratifiedKFold_5_partial1"})
    _write(d, "c.json", {"exp_id": "c", "model": "xgb", "cv_strategy": "StratifiedKFold_7", "cv_scores": [0.7, 0.71, 0.69]})
    _write(d, "broken.json", "{not json")
    _write(d, "lines.json", '{"exp_id": "l1", "model": "m"}\n{"exp_id": "l2", "model": "m"}\n')
    raw = RU.read_raw_logs(spark, d)
    assert sorted(r["exp_id"] for r in raw.collect()) == ["a", "b", "c", "l1", "l2"]
    assert RU.unreadable_logs(spark, d) == 1
    flat = {r["exp_id"]: r for r in RU.flatten_logs(raw).collect()}
    assert flat["b"]["n_feat"] == 0 and len(flat["a"]["notes"]) == 60
    noise = {r["exp_id"]: r for r in RU.fold_noise(raw).collect()}
    assert "b" not in noise and noise["c"]["k"] == 3
    status = lambda ms: RU.resolve_regime(raw, ms, ("StratifiedKFold", 5)).first()
    assert status(["a"])["status"] == "ok"
    assert status(["b"])["status"] == "fallback"
    assert status(["a", "zzz"])["status"] == "fallback"
    r = status(["a", "c"])
    assert r["status"] == "mismatch"
    with pytest.raises(ValueError):
        RU.check_regime(r)
    with pytest.raises(ValueError):
        RU.check_regime(status(["b"]))
    assert RU.check_regime(status(["b"]), allow_fallback=True) == ("StratifiedKFold", 5)


def test_ledger_latest_private_then_public(spark):
    led = spark.createDataFrame([
        ("2026-01-01", "e1", "m1", 0.7, None, "f"), ("2026-01-02", "e1", "m2", 0.71, 0.69, "f"),
        ("2026-01-01", "e2", "m1", 0.6, None, "f"), ("2026-01-01", "nolog", "m", 0.5, None, "f")],
        RU.LEDGER_SCHEMA)
    logs = spark.createDataFrame([("e1", None), ("e2", None), ("e3", 0.9)], "exp_id string, lb_score double")
    got = {r["exp_id"]: r["lb_score"] for r in RU.with_ledger(logs, led).collect()}
    assert got == {"e1": 0.69, "e2": 0.6, "e3": 0.9}


def test_split_store_fails_instead_of_regenerating(spark):
    t, spec = T.load_task(spark, SF_SMALL, "bin")
    tr = T.train_rows(t)
    root = scratch_path(spark, "splits-test")
    s1 = IG.get_or_create_split(spark, tr, spec, root)
    s2 = IG.get_or_create_split(spark, tr, spec, root)
    assert s1.exceptAll(s2).count() == 0
    regime = IG.split_regime(tr, spec)
    with pytest.raises(ValueError, match="match"):
        IG.load_split(spark, root, regime, tr.limit(10))                              # other row count
    with pytest.raises(ValueError, match="no split"):
        IG.load_split(spark, root, {**regime, "n_folds": spec.n_folds + 1}, tr)       # other regime
    with pytest.raises(ValueError, match="match"):
        IG.load_split(spark, root, regime, tr.withColumn("y", 1 - F.col("y")))        # changed target
    with pytest.raises(ValueError, match="already"):
        IG.save_split(IG.split_table(s1.join(tr.select("id", "y"), "id")), root, regime)
    assert IG.load_split(spark, root, regime, tr).count() == tr.count()               # table untouched


GROUP_SPLIT = """
import sys
sys.path.insert(0, {repo!r})
from foldwise.session import local_session
from foldwise.operators import integrity as IG
from foldwise.sources import tasks as T
spark = local_session(2, shuffle_partitions=3)
t, spec = T.load_task(spark, {sf!r}, "grp")
tr = T.train_rows(t).repartition({parts})
if {parts} == 2:
    IG.get_or_create_split(spark, tr, spec, {store!r})
split = IG.load_split(spark, {store!r}, IG.split_regime(tr, spec), tr)
print("SPLIT", IG.content_hash(split, ["id", "fold"]), split.count())
"""


def test_group_split_is_found_by_another_process(tmp_path):
    import subprocess
    import sys

    out = []
    for parts in (2, 7):
        code = GROUP_SPLIT.format(repo=str(Path(__file__).resolve().parents[1]), sf=SF_SMALL, store=str(tmp_path / "s"), parts=parts)
        got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
        out += [line for line in got.stdout.splitlines() if line.startswith("SPLIT")]
    assert len(out) == 2 and out[0] == out[1]


def test_digests_that_look_like_numbers(spark):
    """A group digest of digits, or of digits around one ``e``, names its split like any other."""
    split = spark.createDataFrame([(i, i % 3, i) for i in range(9)], "id long, fold int, y_fp long")
    store = scratch_path(spark, "splits-digest")
    for digest in ("12345678e9012345", "1234567890123456", "0000000000000000"):
        regime = {"strategy": "GroupKFold", "n_folds": 3, "seed": 42, "groups": digest}
        assert IG.read_split(spark, store, regime) is None
        IG.save_split(split, store, regime)
        found = IG.read_split(spark, store, regime)
        assert sorted(found.collect()) == sorted(split.collect()) and found.dtypes == split.dtypes
        with pytest.raises(ValueError, match="already"):
            IG.save_split(split, store, regime)


RACE = """
import pathlib, sys, time
sys.path.insert(0, {repo!r})
from foldwise.session import local_session
from foldwise.operators import integrity as IG
from foldwise.sources import stored, tasks as T
spark = local_session(2, shuffle_partitions=3)
t, spec = T.load_task(spark, {sf!r}, "bin")
tr = T.train_rows(t)
here = pathlib.Path({store!r})
create = stored._create_once
def together(*a):
    (here / "{me}.ready").touch()
    while not (here / "{other}.ready").exists():
        time.sleep(0.01)
    won = create(*a)
    print("WON" if won else "LOST")
    return won
stored._create_once = together
split = IG.get_or_create_split(spark, tr, spec, {store!r} + "/s")
print("SPLIT", IG.content_hash(split, ["id", "fold"]), split.count())
"""


def test_two_processes_publish_one_split(tmp_path):
    """Both have staged their split when the first of them publishes; both end with the same one."""
    import subprocess
    import sys

    repo = str(Path(__file__).resolve().parents[1])
    running = [subprocess.Popen([sys.executable, "-c", RACE.format(repo=repo, sf=SF_SMALL, store=str(tmp_path), me=me, other=other)],
                                stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True) for me, other in ("ab", "ba")]
    out = [line for p in running for line in p.communicate(timeout=300)[0].splitlines()]
    assert sorted(x for x in out if not x.startswith("SPLIT")) == ["LOST", "WON"]
    assert len({x for x in out if x.startswith("SPLIT")}) == 1 and sum(x.startswith("SPLIT") for x in out) == 2
    assert len(list((tmp_path / "s/manifests").iterdir())) == 1 and len(list((tmp_path / "s/data").iterdir())) == 1


def test_interrupted_and_damaged_stores(spark, tmp_path):
    split = spark.createDataFrame([(i, i % 3, i) for i in range(9)], "id long, fold int, y_fp long")
    store, regime = str(tmp_path / "s"), {"strategy": "KFold", "n_folds": 3, "seed": 1, "groups": "none"}
    stored.write_bucketed(split, f"{store}/data/{IG.split_name(regime)}-left-behind", "id", 2)   # staged, never published
    assert IG.read_split(spark, store, regime) is None
    IG.save_split(split, store, regime)
    assert IG.read_split(spark, store, regime).count() == 9
    data = tmp_path / "s" / stored.manifest(spark, store, IG.split_name(regime))["data"]
    next(f for f in data.iterdir() if f.suffix == ".parquet").unlink()
    spark.catalog.clearCache()
    with pytest.raises(Exception):
        IG.read_split(spark, store, regime)


def test_stored_tables_join_without_an_exchange(spark, tmp_path):
    t, spec = T.load_task(spark, SF_SMALL, "bin")
    tr = T.train_rows(t)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        split = IG.get_or_create_split(spark, tr, spec, str(tmp_path / "s"))
        stored.publish(tr, str(tmp_path / "t"), "train", "id")
        train = stored.published(spark, str(tmp_path / "t"), "train")
        joined = IG.attach_split(train, split)
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == tr.count() and joined.exceptAll(IG.attach_split(tr, split)).isEmpty()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_alignment_report_flags_each_defect(spark):
    ref = spark.createDataFrame([(i,) for i in range(10)], "id long")
    rows = [("a", i, 0.1) for i in range(10)] + [("b", i, 0.1) for i in range(10)] + [("b", 3, 0.2)]
    rows += [("c", i, 0.1) for i in range(9)] + [("c", 99, 0.1)]
    long = spark.createDataFrame(rows, "member string, id long, p double")
    rep = {r["member"]: r for r in alignment_report(long, ref, ["a", "b", "c"]).collect()}
    assert (rep["a"]["n_dup_ids"], rep["a"]["n_missing"], rep["a"]["n_extra"]) == (0, 0, 0)
    assert rep["b"]["n_dup_ids"] == 1
    assert rep["c"]["n_missing"] == 1 and rep["c"]["n_extra"] == 1
    with pytest.raises(ValueError):
        check_alignment(alignment_report(long, ref, ["a", "b", "c"]))
    # a permuted but complete member is aligned
    perm = long.where("member = 'a'").orderBy(F.desc("id"))
    check_alignment(alignment_report(perm, ref, ["a"]))


def test_fingerprint_catches_duplicates_and_column_order(spark):
    df = spark.createDataFrame([(1, "x", 0), (2, "y", 0)], "id long, c string, k int")
    a = IG.fingerprint(df, ["k"], ["id", "c"])
    b = IG.fingerprint(df.select("k", "c", "id"), ["k"], ["c", "id"])
    assert IG.fingerprint_diff(a, b, ["k"]).count() == 0
    dup = df.unionByName(df.where("id = 1")).unionByName(df.where("id = 1"))
    assert IG.fingerprint_diff(a, IG.fingerprint(dup, ["k"], ["id", "c"]), ["k"]).count() == 1


def test_spec_preconditions():
    with pytest.raises(ValueError):
        TaskSpec(problem_type="regression", metric="auc")
    with pytest.raises(ValueError):
        TaskSpec(problem_type="regression", metric="rmse", cv_strategy="StratifiedKFold")
    with pytest.raises(ValueError):
        TaskSpec(cv_strategy="GroupKFold")
    with pytest.raises(ValueError):
        TaskSpec(problem_type="multiclass", metric="logloss", te_cols=("c",))
    with pytest.raises(ValueError):
        TaskSpec().validate(trainable=("regression",))
    assert TaskSpec().cv_label(2) == "StratifiedKFold_5_partial2"


def test_case_insensitive_duplicate_columns_are_rejected(spark):
    from foldwise.sources.files import check_columns

    df = spark.createDataFrame([(1, 2)], "x long, y long")
    check_columns(df)
    with pytest.raises(ValueError):
        check_columns(["x", "X"])


def test_roles_fill_and_seeds(spark):
    from foldwise.operators.history import fill_past
    from foldwise.operators import folds as FO

    spec = TaskSpec(categorical_cols=("a", "b", "t"), te_cols=("t", "zz"), extra_categorical_cols=("c", "a"),
                    drop_cols=("d",))
    te, cat = spec.roles(["id", "y", "a", "b", "c", "d", "t"])
    assert te == ["t"] and cat == ["a", "b", "c"]
    assert spec.feature_cols(["id", "y", "a", "d"]) == ["a"]
    df = spark.createDataFrame([(1, None), (2, 2.5)], "id long, f double")
    got = {r["id"]: r["f"] for r in fill_past(df, ["f"]).collect()}
    assert got == {1: 0.0, 2: 2.5} and dict(fill_past(df, ["f"]).dtypes)["f"] == "float"
    rows = spark.createDataFrame([(i, i % 2) for i in range(100)], "id long, y int")
    a = FO.assign_folds(rows, TaskSpec(model_seed=1)).collect()
    b = FO.assign_folds(rows, TaskSpec(model_seed=2)).collect()
    assert sorted(a) == sorted(b)          # the run seed never changes the split
    c = FO.assign_folds(rows, TaskSpec(seed=7)).collect()
    assert sorted(a) != sorted(c)


def _events(spark, n=600):
    import datetime

    d = tempfile.mkdtemp(prefix="foldwise-events-", dir="/tmp")
    rows = [(i, datetime.datetime(2026, 1, 1), i % 9, "view", float(i)) for i in range(n)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{d}/events.parquet")
    return d


def test_log_records_hold_the_best_iterations(spark):
    import __spark_entry__ as E
    from foldwise.plans import experiments as EX

    d = _events(spark)
    per_fold = {(r.exp_id, r.fold): r for r in EX.run_fold_scores(spark, d).collect()}
    got = {r.exp_id: r for r in E.queries()["log_record"](spark, d).collect()}
    for exp_id, r in got.items():
        own = [x for (e, _), x in per_fold.items() if e == exp_id]
        want = None if exp_id.startswith("stack") else max(min(int(x.score * 1200), EX.ITER_CAP - 1) for x in own)
        assert r.max_iter == want and r.k == len(own)
    assert "max_iter" in E.oracle_sql()["log_record"]
    raw, _ = EX.load_runs(spark, d)
    assert {r.exp_id: r.best_iters and max(r.best_iters) for r in raw.collect()} == {e: r.max_iter for e, r in got.items()}
