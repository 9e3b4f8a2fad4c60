"""Experiment runs derived from the task tables, written to and read from logs.

A fixed run plan (the kind of configuration a user keeps) names, per run,
the member prediction it scores, the number of folds and whether it is a
screening run. Fold and leaderboard scores are computed by Spark from the
data: fold AUCs of the member on the run's split, public/private AUC on the
two halves of the test part. Best iterations are simulated: no model is
trained, they are min(floor(AUC * 1200), 999) of the fold. Those of trained
runs come from ``plans.job``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.functions.scalar import uniform
from foldwise.operators import folds as FO
from foldwise.operators import metrics as MT
from foldwise.operators import runs as RU
from foldwise.session import materialize, scratch_path
from foldwise.sources import members as MB
from foldwise.sources import tasks as T

ITER_CAP = 1000
# Fixed run plan: exp_id, model, member, n_folds, folds run (None = all), timestamp, notes, feature_builder
RUN_PLAN = [
    ("exp_001", "lgbm", "p1", 5, None, "2026-01-01T00:00:00+00:00", "baseline on p1", None),
    ("exp_002", "LGBM", "p2", 5, None, "2026-01-02T00:00:00+00:00", "second member, model name in capitals", None),
    ("exp_003", "xgb", "p1", 7, None, "2026-01-03T00:00:00+00:00", "seven folds", "row_example"),
    ("exp_004", "xgb", "p2", 7, None, "2026-01-04T00:00:00+00:00", "seven folds, second member", None),
    ("exp_005", "lgbm", "p3", 5, 2, "2026-01-05T00:00:00+00:00", "screening run on the noise member", None),
    ("exp_006", "lgbm", "p1", 5, None, "2026-01-06T00:00:00+00:00", "rerun of the baseline (same folds, same scores)", None),
    ("exp_007", "lgbm", "p4", 5, None, "2026-01-07T00:00:00+00:00",
     "dominant member; a long note that is cut to sixty characters in the flat table", None),
    ("stack_v1_equal", "stack:equal", "equal", 5, None, "2026-01-08T00:00:00+00:00", "stack over 2 members; meta=equal", None),
]
# Fixed ledger plan: timestamp, exp_id, message, member, with private score
LEDGER_PLAN = [
    ("2026-02-01T00:00:00+00:00", "exp_001", "first submission", "p1", False),
    ("2026-02-02T00:00:00+00:00", "exp_003", "with private score", "p1", True),
    ("2026-02-03T00:00:00+00:00", "exp_004", "try 1", "p2", False),
    ("2026-02-04T00:00:00+00:00", "exp_004", "try 2", "p2", True),
    ("2026-02-05T00:00:00+00:00", "exp_999", "run without a log", "p3", False),
]
STACK_MEMBERS = ("exp_001", "exp_002")


MEMBERS = ("p1", "p2", "p3", "p4")


def _members_long(wide: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(member, id, p) of the members in the columns of ``wide``, and of the mean of two of them."""
    long = MB.long_members(wide, MEMBERS)
    eq = long.where(F.col("member").isin("p1", "p2")).groupBy("id").agg(F.avg("p").alias("p"))
    return long, eq.select(F.lit("equal").alias("member"), "id", "p")


def run_fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(exp_id, fold, score, best_iter) for every run of the plan."""
    task, spec = T.load_task(spark, sf_dir, "syn")
    # every run reads these rows, and the scans of the metric twice
    train = materialize(MB.binary_scores(T.train_rows(task).select("id", "y"), MEMBERS))
    plan = spark.createDataFrame(
        [(e, m, mem, n, k) for e, m, mem, n, k, *_ in RUN_PLAN],
        "exp_id string, model string, member string, n_folds int, folds_run int")
    scored = []
    for n in sorted({r[3] for r in RUN_PLAN}):
        wide = FO.assign_folds(train, spec, n_folds=n)
        f = wide.select("id", "fold", "y")
        long, equal = _members_long(wide)
        per_fold = MT.auc(long.join(f, "id"), ["member", "fold"], out="score")
        pooled = MT.auc(equal.join(f, "id"), ["member"], out="score").withColumn("fold", F.lit(0))
        scored.append(per_fold.unionByName(pooled).withColumn("n_folds", F.lit(n)))
    s = scored[0]
    for x in scored[1:]:
        s = s.unionByName(x)
    j = plan.join(s, ["member", "n_folds"]).where(F.col("folds_run").isNull() | (F.col("fold") < F.col("folds_run")))
    it = F.when(~F.col("model").startswith("stack"),
                F.least(F.floor(F.col("score") * 1200), F.lit(ITER_CAP - 1)).cast("int"))
    return j.select("exp_id", "fold", "score", it.alias("best_iter"))


def run_table(spark: SparkSession) -> DataFrame:
    rows = []
    for e, model, mem, n, k, ts, notes, fb in RUN_PLAN:
        stack = model.startswith("stack")
        label = f"StratifiedKFold_{n}" + (f"_partial{k}" if k else "")
        feats = list(STACK_MEMBERS) if stack else ["user_id", "value"]
        params = {"seed": 42, "feature_recipe": None if stack else
                  {"feature_builder": fb, "target_encode_cols": [], "drop_cols": ["ts"], "extra_categorical_cols": []},
                  "members": list(STACK_MEMBERS) if stack else None, "meta_winner": "equal" if stack else None,
                  "meta_oof": None, "nnls_weights": None}
        rows.append((e, ts, "unknown", model, feats, label, params, notes, "", None))
    schema = ("exp_id string, timestamp string, git_hash string, model string, features array<string>, "
              "cv_strategy string, params " + RU.PARAMS.simpleString() + ", notes string, kill_criterion string, "
              "expectation_path string")
    return spark.createDataFrame(rows, schema)


def ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger entries; scores are member AUCs on the public/private halves of the test part."""
    task, _ = T.load_task(spark, sf_dir, "syn")
    wide = materialize(MB.binary_scores(T.test_rows(task).select("id", "y"), MEMBERS))
    long, equal = _members_long(wide)
    mo = long.unionByName(equal).join(wide.select("id", "y"), "id").withColumn(
        "half", F.when(uniform("id", "pub") < 0.5, F.lit("public")).otherwise(F.lit("private")))
    sc = MT.auc(mo, ["member", "half"], out="score")
    wide = sc.groupBy("member").pivot("half", ["public", "private"]).agg(F.first("score"))
    plan = spark.createDataFrame([(ts, e, msg, mem, priv) for ts, e, msg, mem, priv in LEDGER_PLAN],
                                 "timestamp string, exp_id string, message string, member string, with_private boolean")
    j = plan.join(wide, "member")
    return j.select("timestamp", "exp_id", "message", F.round("public", 6).alias("lb_public"),
                    F.when(F.col("with_private"), F.round("private", 6)).alias("lb_private"),
                    F.concat(F.col("exp_id"), F.lit(".csv")).alias("file"))


def write_runs(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Sink the run logs (JSON) and the ledger (parquet append) in the shared folder."""
    logs = scratch_path(spark, "logs")
    ledger = scratch_path(spark, "ledger")
    RU.write_logs(RU.log_records(run_fold_scores(spark, sf_dir), run_table(spark)), logs)
    ledger_rows(spark, sf_dir).write.mode("append").parquet(ledger)
    return logs, ledger


def load_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(raw logs with lb_score synced from the ledger, ledger)."""
    logs, ledger = write_runs(spark, sf_dir)
    raw = RU.read_raw_logs(spark, logs)
    led = spark.read.schema(RU.LEDGER_SCHEMA).parquet(ledger)
    return RU.with_ledger(raw, led), led
