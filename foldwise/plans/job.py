"""The training job: from a task table to stored split, predictions, models and a log record.

builder -> roles and dropped columns -> stored split -> encoding and one model per fold
(``fit_settings``) -> prediction tables, submission, models -> log record, all under one store
folder and one experiment name.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.operators import integrity as IG
from foldwise.operators import runs as RU
from foldwise.operators.features import apply_builders
from foldwise.plans import oof as OOF
from foldwise.plans.trainers import Trainer
from foldwise.session import materialize
from foldwise.sources.files import check_columns, nan_to_null
from foldwise.sources.stored import exists
from foldwise.spec import TaskSpec


@dataclass
class JobResult:
    run: OOF.OOFRun | None
    exp_id: str
    store: str

    def path(self, kind: str) -> str:
        """``oof``, ``submission``, ``test`` or ``models`` of this experiment; ``logs`` of all."""
        return f"{self.store}/logs" if kind == "logs" else f"{self.store}/{kind}/{self.exp_id}"


def feature_roles(task: DataFrame, spec: TaskSpec, vector_col: str | None) -> tuple[list[str], list[str]]:
    """(numeric, categorical) feature columns after dropping; a column of no usable type is an error."""
    columns = [c for c in task.columns if c not in ("part", vector_col)]
    feats = spec.feature_cols(columns)
    te, cats = spec.roles(columns)
    numeric = [c for c in feats if c not in te and c not in cats]
    odd = [c for c in numeric if not isinstance(task.schema[c].dataType, (T.NumericType, T.BooleanType))]
    if odd:
        raise ValueError(f"columns {odd} are neither numbers nor declared categorical; drop them or declare them")
    return numeric, cats


def _inputs(task: DataFrame, spec: TaskSpec, builder: str | None, builder_args: dict | None,
            vector_col: str | None) -> tuple[DataFrame, list[str], list[str]]:
    """The task with declared categories as text, built features, and its numeric and categorical features."""
    check_columns(task)
    declared = [c for c in (*spec.categorical_cols, *spec.extra_categorical_cols) if c in task.columns]
    task = nan_to_null(task.withColumns({c: F.col(c).cast("string") for c in declared}) if declared else task)
    if builder:
        task = apply_builders(task, builder, **(builder_args or {}))
    return task, *feature_roles(task, spec, vector_col)


def _free(spark: SparkSession, job: JobResult, kinds: Sequence[str]) -> None:
    """Fail before training if a target folder of the experiment exists already."""
    taken = [k for k in kinds if exists(spark, job.path(k))]
    if taken:
        raise ValueError(f"experiment {job.exp_id} has stored {taken} already in {job.store}; choose another name")


def _store(spark: SparkSession, job: JobResult, task: DataFrame, spec: TaskSpec, template: DataFrame | None, builder: str | None,
           notes: str, timestamp: str | None, keep_models: bool) -> None:
    """Write all that a run yields: OOF, test probabilities, submission, models, log record."""
    run = job.run
    if run.oof is not None:
        OOF.write_keyed(OOF.oof_table(run), job.path("oof"), spec.id_col)
        if run.label_map is not None:
            OOF.write_keyed(OOF.test_prob_table(run), job.path("test"), spec.id_col)
        if template is None:
            template = task.where(F.col("part") == "test").select(spec.id_col)
        sub = OOF.submission(template, OOF.test_predictions(run), spec.id_col, spec.target_col)
        OOF.check_submission(sub, template, spec.id_col, spec.target_col)
        OOF.write_table(sub, job.path("submission"))
    if keep_models:
        OOF.save_models(run.models, f"{job.store}/models", job.exp_id)
    RU.write_logs(log_record(spark, job, spec, builder, notes, timestamp), job.path("logs"))


def sweep(spark: SparkSession, task: DataFrame, spec: TaskSpec, settings: dict[str, Trainer], store: str, *,
          builder: str | None = None, builder_args: dict | None = None, vector_col: str | None = None, n_folds: int | None = None,
          max_folds: int | None = None, aug_weight: float | None = None, early_stopping: bool = False,
          template: DataFrame | None = None, notes: str = "", timestamp: str | None = None, keep_models: bool = False,
          parallel: int = OOF.PARALLEL_FITS) -> dict[str, JobResult]:
    """One experiment per setting, under its name: all share one stored split, one encoded feature
    table and the scheduler; each writes its own tables and log record.

    A screening sweep (``max_folds``) writes only the log records.
    """
    store = store.rstrip("/")
    jobs = {name: JobResult(None, name, store) for name in settings}
    for name, t in settings.items():
        OOF.check_trainer(t, spec, aug_weight)
        _free(spark, jobs[name], [] if max_folds is not None else ["oof", "submission", "test"])
    task, numeric, cats = _inputs(task, spec, builder, builder_args, vector_col)
    task = materialize(task)  # the split, its self-check, the parts, the fits and the template read it
    split = IG.get_or_create_split(spark, task.where(F.col("part") == "train"), spec, f"{store}/splits", n_folds)
    prep = OOF.prepare(spark, task, spec, numeric, vector_col=vector_col, n_folds=n_folds, max_folds=max_folds, aug_weight=aug_weight,
                       split=split, categorical=cats)
    try:
        runs = OOF.fit_settings(prep, settings, early_stopping=early_stopping, parallel=parallel)
    finally:
        prep.close()
    for name, job in jobs.items():
        job.run = runs[name]
        _store(spark, job, task, spec, template, builder, notes, timestamp, keep_models)
    return jobs


def train_job(spark: SparkSession, task: DataFrame, spec: TaskSpec, trainer: Trainer, store: str, exp_id: str, **options) -> JobResult:
    """Train one experiment over ``task`` (key, target, features, ``part``) and store all it yields:
    a sweep of one setting, with the options of ``sweep``.

    A screening run (``max_folds``) writes only its log record. The split is created once per
    regime in ``store`` and loaded, with a self-check, by every later run.
    """
    return sweep(spark, task, spec, {exp_id: trainer}, store, **options)[exp_id]


def log_record(spark: SparkSession, job: JobResult, spec: TaskSpec, builder: str | None, notes: str,
               timestamp: str | None) -> DataFrame:
    run = job.run
    stamp = (timestamp or datetime.now(timezone.utc).isoformat())[:19]
    recipe = {"feature_builder": builder, "target_encode_cols": list(spec.te_cols), "drop_cols": list(spec.drop_cols),
              "extra_categorical_cols": list(spec.extra_categorical_cols)}
    params = {"seed": spec.model_seed, "feature_recipe": recipe, "members": None, "meta_winner": None, "meta_oof": None,
              "nnls_weights": None}
    model = type(run.models[0]).__name__ if run.models and not isinstance(run.models[0], dict) else "one model per class"
    runs = spark.createDataFrame(
        [(job.exp_id, stamp, model, list(run.features), run.cv_label, params, notes)],
        "exp_id string, timestamp string, model string, features array<string>, cv_strategy string, params "
        + RU.PARAMS.simpleString() + ", notes string")
    return RU.log_records(run.fold_scores.withColumn("exp_id", F.lit(job.exp_id)), runs)


def members_of(spark: SparkSession, store: str, exp_ids: Sequence[str], target_col: str, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(member, id, p) of the stored OOF tables and of the stored submissions of binary or regression runs."""
    oof = test = None
    for e in exp_ids:
        o = spark.read.parquet(f"{store}/oof/{e}").select(F.lit(e).alias("member"), F.col(id_col).alias("id"), F.col("oof").alias("p"))
        t = spark.read.parquet(f"{store}/submission/{e}").select(
            F.lit(e).alias("member"), F.col(id_col).alias("id"), F.col(target_col).cast("double").alias("p"))
        oof, test = (o, t) if oof is None else (oof.unionByName(o), test.unionByName(t))
    return oof, test


def stored_matrix(spark: SparkSession, store: str, exp_ids: Sequence[str], id_col: str = "id") -> DataFrame:
    """(id, <exp_id>...): the stored OOF tables of binary or regression runs side by side. They are
    bucketed by key, so no row moves; an id that a table lacks is an error of the alignment check, not of this join."""
    out = None
    for e in exp_ids:
        t = OOF.read_keyed(spark, f"{store.rstrip('/')}/oof/{e}", id_col).select(F.col(id_col).alias("id"), F.col("oof").alias(e))
        out = t if out is None else out.join(t, "id")
    return out


def record_stack(spark: SparkSession, stack, store: str, exp_id: str) -> None:
    """Store a stack's tables and log record like those of a run: the next stack can use it as a member."""
    OOF.write_keyed(stack.oof_table, f"{store}/oof/{exp_id}", "id")
    OOF.write_table(stack.test_table, f"{store}/submission/{exp_id}")
    RU.write_logs(stack.log.withColumn("exp_id", F.lit(exp_id)), f"{store}/logs")
