"""Experiment logs, submission ledger and the views built on them.

A run log is one JSON record per run (schema below); the ledger is an
append-only table of submissions. ``lb_score`` is a *view*: the latest
ledger row of a run (private score if present, else public) over the
logged value, instead of rewriting log files in place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.functions.scalar import parse_regime
from foldwise.session import with_scalars
from foldwise.spec import STRATEGIES, greater_is_better

RECIPE = T.StructType([
    T.StructField("feature_builder", T.StringType()),
    T.StructField("target_encode_cols", T.ArrayType(T.StringType())),
    T.StructField("drop_cols", T.ArrayType(T.StringType())),
    T.StructField("extra_categorical_cols", T.ArrayType(T.StringType())),
])
PARAMS = T.StructType([
    T.StructField("seed", T.LongType()),
    T.StructField("feature_recipe", RECIPE),
    T.StructField("members", T.ArrayType(T.StringType())),
    T.StructField("meta_winner", T.StringType()),
    T.StructField("meta_oof", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("nnls_weights", T.MapType(T.StringType(), T.DoubleType())),
])
LOG_SCHEMA = T.StructType([
    T.StructField("exp_id", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("git_hash", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("features", T.ArrayType(T.StringType())),
    T.StructField("cv_strategy", T.StringType()),
    T.StructField("cv_scores", T.ArrayType(T.DoubleType())),
    T.StructField("cv_mean", T.DoubleType()),
    T.StructField("cv_std", T.DoubleType()),
    T.StructField("best_iters", T.ArrayType(T.IntegerType())),
    T.StructField("lb_score", T.DoubleType()),
    T.StructField("params", PARAMS),
    T.StructField("notes", T.StringType()),
    T.StructField("kill_criterion", T.StringType()),
    T.StructField("expectation_path", T.StringType()),
])
LEDGER_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("exp_id", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("lb_public", T.DoubleType()),
    T.StructField("lb_private", T.DoubleType()),
    T.StructField("file", T.StringType()),
])


def log_records(fold_scores: DataFrame, runs: DataFrame, run_key: str = "exp_id", fold_col: str = "fold",
                score_col: str = "score", iter_col: str | None = "best_iter") -> DataFrame:
    """One log record per run from its per-fold scores (grouped, no driver loop).

    Scores rounded to 6 digits, cv_mean = mean, cv_std = population std.
    ``runs`` carries the descriptive columns (model, features, cv_strategy,
    params, notes, timestamp, ...).
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(fold_col).alias("f"), F.col(score_col).alias("s"),
                                                   (F.col(iter_col) if iter_col else F.lit(None).cast("int")).alias("i"))))
    agg = fold_scores.groupBy(run_key).agg(
        ordered.alias("_fs"), F.round(F.avg(score_col), 6).alias("cv_mean"),
        F.round(F.stddev_pop(score_col), 6).alias("cv_std"))
    agg = agg.select(
        run_key, F.transform("_fs", lambda x: F.round(x["s"], 6)).alias("cv_scores"), "cv_mean", "cv_std",
        F.when(F.exists("_fs", lambda x: x["i"].isNotNull()), F.transform("_fs", lambda x: x["i"].cast("int")))
        .alias("best_iters"))
    out = runs.join(agg, run_key, "left")
    cols = []
    for f in LOG_SCHEMA.fields:
        cols.append((F.col(f.name) if f.name in out.columns else F.lit(None)).cast(f.dataType).alias(f.name))
    return out.select(*cols)


def write_logs(records: DataFrame, path: str) -> None:
    """Append run records as JSON (one record per line, partition files)."""
    records.write.mode("append").json(path)


def scan_logs(spark: SparkSession, path: str) -> DataFrame:
    """Every record of a log folder with the explicit schema, plus ``_corrupt_record``.

    A file may hold one pretty-printed record or one record per line. Each file is read as
    one text (log files are small) and split at line ends only when it is no single record.
    """
    whole = spark.read.text(path, wholetext=True)
    schema = T.StructType(LOG_SCHEMA.fields + [T.StructField("_corrupt_record", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parse = lambda c: F.from_json(c, schema, options)
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    per_line = F.forall(lines, lambda x: x.rlike(r"^\s*\{.*\}\s*$"))
    texts = whole.select(F.explode(F.when(per_line, lines).otherwise(F.array("value"))).alias("value"))
    return texts.where(F.trim("value") != "").select(parse(F.col("value")).alias("r")).select("r.*")


def read_raw_logs(spark: SparkSession, path: str) -> DataFrame:
    """The readable records of a log folder."""
    return scan_logs(spark, path).where(F.col("_corrupt_record").isNull() & F.col("exp_id").isNotNull()).drop("_corrupt_record")


def unreadable_logs(spark: SparkSession, path: str) -> int:
    """Records that ``read_raw_logs`` leaves out."""
    return scan_logs(spark, path).where(F.col("_corrupt_record").isNotNull() | F.col("exp_id").isNull()).count()


def flatten_logs(raw: DataFrame) -> DataFrame:
    """One flat row per run: missing lists count 0, notes cut to 60 characters."""
    return raw.select(
        "exp_id", "model", "cv_mean", "cv_std", "lb_score",
        F.coalesce(F.size("features"), F.lit(0)).cast("int").alias("n_feat"),
        F.col("params.feature_recipe.feature_builder").alias("feature_builder"),
        F.substring(F.coalesce(F.col("notes"), F.lit("")), 1, 60).alias("notes"),
        "timestamp",
    )


def ledger_scores(ledger: DataFrame) -> DataFrame:
    """(exp_id, lb_score) of the latest submission per run: private if present, else public."""
    w = Window.partitionBy("exp_id").orderBy(F.col("timestamp").desc(), F.col("message").desc())
    latest = ledger.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1)
    return latest.select("exp_id", F.coalesce("lb_private", "lb_public").alias("_lb")).where(F.col("_lb").isNotNull())


def with_ledger(logs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Logs with lb_score synced from the ledger (runs without a log are ignored)."""
    lb = ledger_scores(ledger)
    return logs.join(lb, "exp_id", "left").withColumn("lb_score", F.coalesce("_lb", "lb_score")).drop("_lb")


def leaderboard(logs: DataFrame, sort_by: str = "cv_mean", metric: str = "auc") -> DataFrame:
    """Direction-aware sort, nulls last, exp_id tie-break; adds ``position``."""
    by = sort_by if sort_by in logs.columns else "cv_mean"
    asc = (not greater_is_better(metric)) if by in ("cv_mean", "lb_score") else False
    o = F.col(by).asc_nulls_last() if asc else F.col(by).desc_nulls_last()
    # a leaderboard holds one row per run: a single ordered window over it is fine
    w = Window.orderBy(o, F.col("exp_id").asc())
    return logs.withColumn("position", F.row_number().over(w))


def log_filter(raw: DataFrame, model: str | None = None, group_sub: str | None = None,
               exclude: str | None = None) -> DataFrame:
    """Case-insensitive model equality AND exp_id substring, excluding one run."""
    cond = F.lit(True)
    if model:
        cond = cond & (F.lower(F.coalesce(F.col("model"), F.lit(""))) == model.lower())
    if group_sub:
        cond = cond & F.coalesce(F.col("exp_id"), F.lit("")).contains(group_sub)
    if exclude:
        cond = cond & (F.col("exp_id") != exclude)
    return raw.where(cond)


def recent_runs(filtered: DataFrame, n: int = 5) -> DataFrame:
    """The n most recent comparable runs (top-n is the feature)."""
    return filtered.orderBy(F.col("timestamp").desc_nulls_last(), F.col("exp_id")).limit(n)


def anchor_run(raw: DataFrame, filtered: DataFrame, baseline: str | None = None) -> DataFrame:
    """Named baseline if logged, else the most recent comparable run (one row)."""
    base = raw.where(F.col("exp_id") == baseline).withColumn("_prio", F.lit(0)) if baseline else None
    recent = filtered.withColumn("_prio", F.lit(1))
    cand = recent if base is None else base.unionByName(recent)
    return cand.orderBy("_prio", F.col("timestamp").desc_nulls_last(), "exp_id").limit(1).drop("_prio")


def fold_noise(raw: DataFrame) -> DataFrame:
    """Per run: k, mean, sample std (ddof=1), SE = std/sqrt(k); runs with k < 2 drop out."""
    e = raw.select("exp_id", F.explode("cv_scores").alias("s"))
    g = e.groupBy("exp_id").agg(F.count("s").alias("k"), F.avg("s").alias("mean"), F.stddev_samp("s").alias("std"))
    return g.where(F.col("k") >= 2).withColumn("se", F.col("std") / F.sqrt("k"))


def noise_floor(anchor: DataFrame, group: DataFrame) -> DataFrame:
    """Anchor SE, 2*SE threshold and the spread of the group's cv_mean (needs >= 2 runs)."""
    a = fold_noise(anchor).select(F.col("exp_id").alias("anchor"), "k", "mean", "std", "se",
                                  (2 * F.col("se")).alias("two_se"))
    g = group.where(F.col("cv_mean").isNotNull()).agg(
        F.count("cv_mean").alias("n_group"), F.min("cv_mean").alias("g_min"), F.max("cv_mean").alias("g_max"),
        F.stddev_samp("cv_mean").alias("g_std"))
    g = g.select("n_group", *[F.when(F.col("n_group") >= 2, F.col(c)).alias(c) for c in ("g_min", "g_max", "g_std")])
    g = g.withColumn("g_spread", F.col("g_max") - F.col("g_min"))
    return with_scalars(a, g)


def unconverged_folds(raw: DataFrame, cap: int) -> DataFrame:
    """Folds whose best iteration reached the cap (>= cap - 1)."""
    e = raw.select("exp_id", F.posexplode("best_iters").alias("fold", "best_iter"))
    return e.where(F.col("best_iter") >= cap - 1)


def resolve_regime(raw: DataFrame, members: Sequence[str], default: tuple[str, int]) -> DataFrame:
    """One row (strategy, n_folds, status) for the members' common CV regime.

    status: 'ok'; 'fallback' when a member log is missing or its label does
    not parse (partial run); 'mismatch' when members disagree (caller raises).
    """
    spark = raw.sparkSession
    ml = spark.createDataFrame([(m,) for m in members], "exp_id string")
    j = ml.join(raw.select("exp_id", "cv_strategy"), "exp_id", "left")
    strat, n = parse_regime(F.col("cv_strategy"))
    agg = j.agg(
        F.count_if(F.col("cv_strategy").isNull()).alias("n_missing"),
        F.countDistinct(F.coalesce("cv_strategy", F.lit(""))).alias("n_labels"),
        F.first(F.col("cv_strategy"), ignorenulls=True).alias("label"),
    )
    s, k = parse_regime(F.col("label"))
    known = s.isin(*sorted(STRATEGIES)) & (k != "")
    status = (F.when(F.col("n_missing") > 0, F.lit("fallback")).when(F.col("n_labels") > 1, F.lit("mismatch"))
              .when(~known, F.lit("fallback")).otherwise(F.lit("ok")))
    return agg.select(
        F.when(status == "ok", s).otherwise(F.lit(default[0])).alias("strategy"),
        F.when(status == "ok", k.cast("int")).otherwise(F.lit(default[1])).alias("n_folds"),
        status.alias("status"))


def check_regime(regime_row, allow_fallback: bool = False) -> tuple[str, int]:
    """(strategy, folds) of the members; without logs of full runs only when the caller allows it."""
    if regime_row["status"] == "mismatch":
        raise ValueError("member runs use different CV regimes; stack only members of one split")
    if regime_row["status"] == "fallback" and not allow_fallback:
        raise ValueError("a member has no log of a full run; its CV regime is unknown")
    return regime_row["strategy"], int(regime_row["n_folds"])
