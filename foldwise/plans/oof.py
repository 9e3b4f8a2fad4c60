"""Out-of-fold training: one model per fold, OOF + test predictions, scores, log.

validate -> parts -> split -> (nested target encoding for all folds at
once) -> per fold: augment, fit, predict valid + test -> fold scores in one
grouped job -> sinks -> log record. ``prepare`` makes the encoded feature
table once; fits over it, of the folds of one setting or of several, run
side by side in scheduler pools. Every step inside is distributed; the
driver's threads only wait for their jobs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.operators import folds as FO
from foldwise.operators import integrity as IG
from foldwise.functions.scalar import argmax_code
from foldwise.operators import metrics as MT
from foldwise.operators.encode import TargetEncoding, fit_target_encoding
from foldwise.operators.labels import LabelMap, fit_label_map
from foldwise.operators.integrity import fingerprint
from foldwise.operators.vocab import augment_train, category_codes, category_vocab
from foldwise.plans.trainers import Trainer
from foldwise.session import materialize
from foldwise.sources.stored import bucket_count, read_bucketed, write_bucketed
from foldwise.spec import TaskSpec


MAX_TREE_CATEGORIES = 10_000  # a vocabulary above this belongs to target encoding


@dataclass
class OOFRun:
    oof: DataFrame | None       # (id, fold, y|code, p|probs); None for screening runs
    test: DataFrame | None      # (id, p|probs) mean over the fold models
    fold_scores: DataFrame      # (fold, score, best_iter)
    cv_scores: list[float]
    best_iters: list[int | None]
    oof_score: float | None
    cv_label: str
    label_map: LabelMap | None
    models: list
    input_fingerprints: DataFrame | None = None  # (fold, role, n, x, s) when captured
    id_col: str = "id"          # the task's own names; the tables here use id and y
    target_col: str = "y"
    features: tuple[str, ...] = ()


def own_names(task: DataFrame, spec: TaskSpec) -> tuple[DataFrame, TaskSpec, dict[str, str]]:
    """The task with key and target renamed to ``id`` and ``y``, the spec to match, and the
    renaming. Another column of such a name becomes ``<name>_feature``."""
    missing = [c for c in (spec.id_col, spec.target_col) if c not in task.columns]
    if missing:
        raise ValueError(f"task table lacks {missing}")
    roles = {spec.id_col: "id", spec.target_col: "y"}
    names = {c: roles.get(c, f"{c}_feature" if c in ("id", "y") else c) for c in task.columns}
    told = lambda cols: tuple(names.get(c, c) for c in cols)
    inner = replace(spec, id_col="id", target_col="y", te_cols=told(spec.te_cols), group_keys=told(spec.group_keys),
                    categorical_cols=told(spec.categorical_cols), drop_cols=told(spec.drop_cols),
                    numeric_cols=told(spec.numeric_cols), extra_categorical_cols=told(spec.extra_categorical_cols),
                    sequence_col=names.get(spec.sequence_col, spec.sequence_col))
    return task.toDF(*[names[c] for c in task.columns]), inner, names


class Inputs:
    """Turns rows into feature vectors: numbers with the train part's mean for missing values and
    an indicator of them, category codes with nominal metadata and a code for missing values."""

    def __init__(self, folded: DataFrame, numeric: Sequence[str], encoded: Sequence[str], categories: dict[str, int],
                 vector_col: str | None, folds: Sequence[int]):
        self.numeric, self.encoded, self.categories, self.vector_col = list(numeric), list(encoded), categories, vector_col
        sums = [F.sum(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(self.numeric)]
        counts = [F.count(F.col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(self.numeric)]
        rows = folded.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *sums, *counts).collect() if numeric else []
        self.means = {k: [_mean([(r[f"s{i}"] or 0.0, r[f"c{i}"]) for r in rows if r["fold"] != k])
                          for i in range(len(self.numeric))] for k in folds}
        self.flagged = [c for i, c in enumerate(self.numeric) if sum(r["n"] - r[f"c{i}"] for r in rows)]

    def assemble(self, df: DataFrame, k: int) -> DataFrame:
        cols, names = [], []

        def add(col, name, meta=None):
            cols.append(col.alias(f"_f_{name}", metadata=meta) if meta else col.alias(f"_f_{name}"))
            names.append(f"_f_{name}")

        for c, m in zip(self.numeric, self.means[k]):
            add(F.coalesce(F.col(c).cast("double"), F.lit(m)), c)
        for c in self.flagged:
            add(F.col(c).isNull().cast("double"), f"{c}_missing")
        for c in self.encoded:
            add(F.col(c).cast("double"), c)
        for c, n in self.categories.items():
            add(F.coalesce(F.col(f"{c}_code").cast("double"), F.lit(float(n))), c,
                {"ml_attr": {"type": "nominal", "name": c, "num_vals": n + 1}})
        if self.vector_col:
            add(array_to_vector(F.col(self.vector_col)), "vec")
        return VectorAssembler(inputCols=names, outputCol="features").transform(df.select("*", *cols))

    @property
    def max_categories(self) -> int:
        return max(self.categories.values(), default=0) + 1


def _mean(parts: list[tuple[float, int]]) -> float:
    n = sum(c for _, c in parts)
    return float(sum(s for s, _ in parts)) / n if n else 0.0


PARALLEL_FITS = 4  # fits that run side by side


def run_side_by_side(tasks: Sequence[Callable], spark: SparkSession, parallel: int = PARALLEL_FITS) -> list:
    """Results of ``tasks`` in their order, up to ``parallel`` at a time, each in a scheduler pool of
    its own, so that with the FAIR scheduler no fit waits for the stages of another. The threads
    take over the caller's job group and other local properties."""
    sc = spark.sparkContext

    def pooled(i: int, task: Callable):
        def run():
            sc.setLocalProperty("spark.scheduler.pool", f"fit-{i % parallel}")
            return task()
        return inheritable_thread_target(spark)(run)

    if parallel <= 1 or len(tasks) == 1:
        return [t() for t in tasks]
    with ThreadPoolExecutor(max_workers=min(parallel, len(tasks))) as pool:
        waiting = [pool.submit(pooled(i, t)) for i, t in enumerate(tasks)]
        return [w.result() for w in waiting]


@dataclass
class Prepared:
    """What every fit of a task shares: the split, the encoded rows of all folds, the feature inputs."""
    spark: SparkSession
    spec: TaskSpec
    rows: DataFrame             # train rows: fold, label, encodings of all outer folds as arrays
    test_rows: DataFrame
    source: DataFrame | None
    enc: TargetEncoding | None
    inputs: Inputs
    label: object
    label_map: LabelMap | None
    n_folds: int
    folds_run: list[int]
    partial: bool
    aug_weight: float | None
    fcols: list[str]
    vector_col: str | None
    own_id: str
    own_target: str
    held: list[DataFrame] = field(default_factory=list)

    def close(self) -> None:
        for d in self.held:
            d.unpersist()

    def encode(self, df: DataFrame, k: int) -> DataFrame:
        return df.withColumns({f"{c}_te": F.get(f"_te_{c}", F.lit(k)) for c in self.spec.te_cols})


def prepare(spark: SparkSession, task: DataFrame, spec: TaskSpec, numeric: Sequence[str], *, vector_col: str | None = None,
            n_folds: int | None = None, max_folds: int | None = None, aug_weight: float | None = None,
            split: DataFrame | None = None, categorical: Sequence[str] = ()) -> Prepared:
    """Parts, folds, label, codes and nested encodings of a keyed task with a ``part`` column
    (train, test, source), computed once and cached until ``close``."""
    own_id, own_target = spec.id_col, spec.target_col
    task, spec, names = own_names(task, spec)
    numeric, categorical = [names.get(c, c) for c in numeric], [names.get(c, c) for c in categorical]
    vector_col = names.get(vector_col, vector_col)
    n = n_folds or spec.n_folds
    pt = spec.problem_type
    te_cols = list(spec.te_cols)
    cats = [c for c in categorical if c not in te_cols]
    sizes: dict[str, int] = {}
    if cats:
        vocab = materialize(category_vocab([task], cats))
        sizes = {c: 0 for c in cats} | {r["col"]: r["count"] for r in vocab.groupBy("col").count().collect()}
        large = [c for c, x in sizes.items() if x > MAX_TREE_CATEGORIES]
        if large:
            raise ValueError(f"{large} have more than {MAX_TREE_CATEGORIES} values; use target encoding")
        task = category_codes(task, vocab, cats)
    lm = None
    if pt == "multiclass":
        lm = fit_label_map(spark, task.where(F.col("part") == "train"), "y", spec.n_classes)
        task = lm.encode(task.withColumn("y", F.when(F.col("part") != "test", F.col("y"))))
    else:
        task = task.withColumn("y", spec.cast_target("y"))
    label = F.col("code" if lm else "y").cast("double")
    train = task.where(F.col("part") == "train")
    test = task.where(F.col("part") == "test")
    source = task.where(F.col("part") == "source") if aug_weight is not None else None
    folds_run = list(range(n if max_folds is None else min(max_folds, n)))
    narrow = train.select(*dict.fromkeys(["id", "y", *te_cols, *spec.group_keys]))
    if split is not None:
        folded = IG.attach_split(narrow, split.withColumnRenamed(own_id, "id"))
    else:
        folded = FO.assign_folds(narrow, spec, n)
    # all that is known of a row joins in narrow tables; the whole row moves once
    enc, extra = None, folded.select("id", "fold")
    if te_cols:
        # group folds outside -> group inner folds too, so no group spans both inner parts
        inner_groups = spec.group_keys if spec.cv_strategy == "GroupKFold" else ()
        enc = fit_target_encoding(folded, te_cols, n, smoothing=spec.te_smoothing, seed=spec.seed,
                                  problem_type=pt, outer_folds=folds_run, group_keys=inner_groups)
        own = {f"{c}_tes": f"_te_{c}" for c in te_cols}
        extra = enc.rows.drop("j").withColumnsRenamed(own)
        test = enc.apply_all(test).withColumnsRenamed(own)
    rows = train.join(extra, "id").withColumn("label", label).persist(StorageLevel.MEMORY_AND_DISK)
    test = test.withColumn("label", F.lit(0.0)).persist(StorageLevel.MEMORY_AND_DISK)
    encoded = [f"{c}_te" for c in te_cols]
    inputs = Inputs(rows, numeric, encoded, sizes, vector_col, folds_run)
    return Prepared(spark, spec, rows, test, source, enc, inputs, label, lm, n, folds_run, max_folds is not None, aug_weight,
                    [*numeric, *[f"{c}_code" for c in sizes], *encoded], vector_col, own_id, own_target, [rows, test])


def _fit_fold(prep: Prepared, trainer: Trainer, k: int, early_stopping: bool, capture_inputs: bool):
    """(model, best iteration, valid predictions, test predictions, input fingerprints) of one fold."""
    spec, inputs = prep.spec, prep.inputs
    pt = spec.problem_type
    ycol, out_col = ("code" if prep.label_map else "y"), ("probs" if prep.label_map else "p")
    k_classes = prep.label_map.n_classes if prep.label_map else None
    tr = prep.encode(prep.rows.where(F.col("fold") != k), k)
    va = prep.encode(prep.rows.where(F.col("fold") == k), k)
    te = prep.encode(prep.test_rows, k)
    fit_df = tr.withColumn("_is_val", F.lit(False))
    if prep.source is not None:
        src = prep.source.withColumn("label", prep.label).withColumns({"fold": F.lit(-1), "_is_val": F.lit(False)})
        if prep.enc is not None:
            src = prep.enc.apply(src.withColumn("k", F.lit(k))).drop("k")
        fit_df = augment_train(fit_df, src, float(prep.aug_weight), trainer.supports_weight).drop("is_source")
    else:
        fit_df = fit_df.withColumn("w", F.lit(1.0))
    if early_stopping:
        fit_df = fit_df.unionByName(va.withColumn("w", F.lit(1.0)).withColumn("_is_val", F.lit(True)),
                                    allowMissingColumns=True)
    prints = []
    if capture_inputs:
        # content fingerprint of what each model sees, per fold and role (input-equivalence gate)
        for role, d, cols in (("fit", fit_df.where(~F.col("_is_val")), [*sorted(prep.fcols), "label", "w"]),
                              ("valid", va, [*sorted(prep.fcols), "id"]), ("predict", te, [*sorted(prep.fcols), "id"])):
            prints.append(fingerprint(d.withColumn("fold", F.lit(k)).withColumn("role", F.lit(role)), ["fold", "role"], cols))
    fit_in = inputs.assemble(fit_df, k).select("features", "label", "w", "_is_val")
    fit_in = fit_in.persist(StorageLevel.MEMORY_AND_DISK)  # iterative learners scan it many times
    try:
        model = trainer.fit(fit_in, pt, seed=spec.model_seed, weight_col="w" if trainer.supports_weight else None,
                            validation_col="_is_val" if early_stopping else None, max_categories=inputs.max_categories)
    finally:
        fit_in.unpersist()
    pv = trainer.predict(model, inputs.assemble(va, k), pt, k_classes).select("id", "fold", ycol, out_col)
    pt_df = trainer.predict(model, inputs.assemble(te, k), pt, k_classes).select("id", F.lit(k).alias("k"), out_col)
    return model, trainer.metadata(model).get("best_iter"), pv, pt_df, prints


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for d in parts[1:]:
        out = out.unionByName(d)
    return out


def _gather(prep: Prepared, fits: Sequence[tuple]) -> OOFRun:
    """The run that the fits of all folds make together."""
    spec, lm = prep.spec, prep.label_map
    ycol, out_col = ("code" if lm else "y"), ("probs" if lm else "p")
    mc = lm is not None
    oof = materialize(_union([f[2] for f in fits]))  # later reads need no model and no cached input
    test_mean = None
    if not prep.partial:
        test_mean = materialize(mean_prediction(_union([f[3] for f in fits]), out_col, lm.n_classes if lm else None))
    scores = MT.score(oof, spec.metric, ["fold"], y=ycol, p=out_col, multiclass=mc).collect()  # K rows
    sdict = {r["fold"]: r["score"] for r in scores}
    cv_scores = [float(sdict[k]) if sdict.get(k) is not None else float("nan") for k in prep.folds_run]
    oof_score = None
    if not prep.partial:
        row = MT.score(oof, spec.metric, [], y=ycol, p=out_col, multiclass=mc).first()
        oof_score = float(row[0]) if row[0] is not None else None
    best = [f[1] for f in fits]
    fs = prep.spark.createDataFrame(list(zip(prep.folds_run, cv_scores, best)), "fold int, score double, best_iter int")
    label_txt = f"{spec.cv_strategy}_{prep.n_folds}" + (f"_partial{len(prep.folds_run)}" if prep.partial else "")
    prints = [d for f in fits for d in f[4]]
    fp = materialize(_union(prints)) if prints else None  # computed while the encoded inputs are still cached
    return OOFRun(None if prep.partial else oof, test_mean, fs, cv_scores, best, oof_score, label_txt, lm, [f[0] for f in fits], fp,
                  prep.own_id, prep.own_target, tuple(prep.fcols) + ((prep.vector_col,) if prep.vector_col else ()))


def check_trainer(trainer: Trainer, spec: TaskSpec, aug_weight: float | None) -> None:
    spec.validate(trainer.problem_types)
    if aug_weight is not None and aug_weight != 1.0 and not trainer.supports_weight:
        raise ValueError(f"trainer {trainer.name} takes no weights; augmentation weight must be 1.0")


def fit_settings(prep: Prepared, trainers: dict[str, Trainer], *, early_stopping: bool = False, capture_inputs: bool = False,
                 parallel: int = PARALLEL_FITS) -> dict[str, OOFRun]:
    """A run per setting over one prepared task; all (setting, fold) fits run side by side."""
    for t in trainers.values():
        check_trainer(t, prep.spec, prep.aug_weight)
    todo = [(name, k) for name in trainers for k in prep.folds_run]
    fits = run_side_by_side([lambda name=name, k=k: _fit_fold(prep, trainers[name], k, early_stopping, capture_inputs) for name, k in todo],
                            prep.spark, parallel)
    return {name: _gather(prep, [f for (m, _), f in zip(todo, fits) if m == name]) for name in trainers}


def run_oof(spark: SparkSession, task: DataFrame, spec: TaskSpec, trainer: Trainer, numeric: Sequence[str],
            *, vector_col: str | None = None, n_folds: int | None = None, max_folds: int | None = None,
            aug_weight: float | None = None, early_stopping: bool = False, split: DataFrame | None = None,
            categorical: Sequence[str] = (), capture_inputs: bool = False, parallel: int = PARALLEL_FITS) -> OOFRun:
    """One model per fold over a keyed task with a ``part`` column (train, test, source).

    Key and target may have any name (``spec``). ``categorical`` columns get fixed codes from
    one vocabulary over train, test and source. ``split`` is a (key, fold) table; without it
    the folds are dealt by the spec.
    """
    check_trainer(trainer, spec, aug_weight)
    task = materialize(task)  # the parts, the split, the means and every fit read it
    prep = prepare(spark, task, spec, numeric, vector_col=vector_col, n_folds=n_folds, max_folds=max_folds, aug_weight=aug_weight,
                   split=split, categorical=categorical)
    try:
        return fit_settings(prep, {trainer.name: trainer}, early_stopping=early_stopping, capture_inputs=capture_inputs,
                            parallel=parallel)[trainer.name]
    finally:
        prep.close()


def mean_prediction(preds: DataFrame, out_col: str = "p", n_classes: int | None = None) -> DataFrame:
    """Mean over models (folds or seeds) of the predictions of each id."""
    if n_classes is None:
        return preds.groupBy("id").agg(F.avg(out_col).alias(out_col))
    mean = preds.groupBy("id").agg(*[F.avg(F.element_at(out_col, i + 1)).alias(f"_c{i}") for i in range(n_classes)])
    return mean.select("id", F.array(*[f"_c{i}" for i in range(n_classes)]).alias(out_col))


# ------------------------------------------------------------------ sinks (prediction contract)
def probs_wide(df: DataFrame, classes: Sequence, prefix: str = "", id_col: str = "id",
               probs: str = "probs") -> DataFrame:
    """Array of K probabilities -> K columns named <prefix><label> (label-map order)."""
    return df.select(F.col("id").alias(id_col), *[F.element_at(probs, i + 1).alias(f"{prefix}{c}")
                                                  for i, c in enumerate(classes)])


def oof_table(run: OOFRun, id_col: str | None = None) -> DataFrame:
    """[id, oof] or [id, oof_<label>...] (classes in label-map order); the key under its own name."""
    id_col = id_col or run.id_col
    if run.oof is None:
        raise ValueError("screening runs write no OOF table")
    if run.label_map is None:
        return run.oof.select(F.col("id").alias(id_col), F.col("p").alias("oof"))
    return probs_wide(run.oof, run.label_map.classes, "oof_", id_col)


def test_prob_table(run: OOFRun, id_col: str | None = None) -> DataFrame:
    """Multiclass only: [id, <label>...] test probabilities (argmax drops them)."""
    return probs_wide(run.test, [str(c) for c in run.label_map.classes], "", id_col or run.id_col)


def test_predictions(run: OOFRun) -> DataFrame:
    """(id, pred): the mean test prediction; for multiclass the label of the highest probability."""
    if run.label_map is None:
        return run.test.select(F.col("id"), F.col("p").alias("pred"))
    coded = run.test.select("id", argmax_code("probs").alias("code"))
    return run.label_map.decode(coded, "code", "pred").select("id", "pred")


def read_template(spark: SparkSession, path: str, id_col: str) -> DataFrame:
    """A submission template: its key column and order of columns; keys must be unique."""
    t = spark.read.option("header", True).option("inferSchema", True).csv(path) if path.endswith(".csv") \
        else spark.read.parquet(path)
    if id_col not in t.columns:
        raise ValueError(f"the template has no column {id_col!r}")
    if t.groupBy(id_col).count().where("count > 1").limit(1).count():
        raise ValueError("the template repeats a key")
    return t


def submission(template: DataFrame, pred: DataFrame, id_col: str, target_col: str) -> DataFrame:
    """Template rows with the target replaced by the prediction (key join, not position)."""
    j = template.select(id_col).join(pred.select(F.col("id").alias(id_col), F.col("pred").alias(target_col)),
                                     id_col, "left")
    return j


def check_submission(sub: DataFrame, template: DataFrame, id_col: str, target_col: str) -> None:
    row = sub.agg(F.count_if(F.col(target_col).isNull()).alias("nulls"), F.count(F.lit(1)).alias("n")).first()
    n_t = template.count()
    if row["nulls"] or row["n"] != n_t:
        raise ValueError(f"submission has {row['nulls']} missing predictions, {row['n']} rows vs template {n_t}")


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_keyed(df: DataFrame, path: str, key: str) -> None:
    """Write a prediction table bucketed by its key, in one number of buckets for all of a store."""
    write_bucketed(df, path, key, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def read_keyed(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A table of ``write_keyed`` with its buckets; their number is that of its files."""
    plain = spark.read.parquet(path)
    return read_bucketed(spark, path, plain.schema, key, bucket_count(spark, path))


def save_models(models, root: str, exp_id: str) -> None:
    for k, m in enumerate(models):
        for name, one in ([(f"_class{c}", x) for c, x in m.items()] if isinstance(m, dict) else [("", m)]):
            one.write().overwrite().save(f"{root.rstrip('/')}/{exp_id}_fold{k}{name}")
