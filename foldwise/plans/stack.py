"""Stacking: cross-validated meta-learners over member prediction tables.

Consumes only the prediction-table contract (member, id, p|probs); never a
model. Every meta is fitted on the same split as its members (fold != f,
predict fold = f), then refitted on all rows for the test prediction; all
folds of one meta are fitted in shared passes (see operators.solvers).
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.functions.scalar import logit
from foldwise.operators import blend as BL
from foldwise.operators import metrics as MT
from foldwise.operators import solvers as SV
from foldwise.operators.members import member_matrix
from foldwise.session import materialize
from foldwise.spec import greater_is_better

METAS = {
    "binary": ("equal", "rank_mean", "logistic", "nnls"),
    "regression": ("equal", "linear", "nnls"),
    "multiclass": ("equal", "multinomial", "nnls"),
}


@dataclass
class MetaResult:
    name: str
    oof: DataFrame        # (id, fold, y|code, p|probs)
    test: DataFrame       # (id, p|probs)
    oof_score: float
    detail: dict = field(default_factory=dict)


def _sigmoid(z):
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def train_matrix(oof_long: DataFrame, train: DataFrame, members: list[str]) -> DataFrame:
    """(id, <member>..., and the columns of ``train``), written once: every fit and score reads it."""
    return materialize(member_matrix(oof_long, members).join(train, "id"))


def meta_binary_or_regression(name: str, oof_long: DataFrame, test_long: DataFrame, train: DataFrame,
                              members: list[str], n_folds: int, problem_type: str,
                              matrix: DataFrame | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """OOF (id, fold, y, p) and test (id, p) of one meta for binary/regression. ``matrix`` is a
    ``train_matrix`` that several metas share."""
    M = len(members)
    if name == "equal":
        mean = sum((F.col(m) for m in members), F.lit(0.0)) / M
        X = train_matrix(oof_long, train, members) if matrix is None else matrix
        Xt = member_matrix(test_long, members)
        return X.select("id", "fold", "y", mean.alias("p")), Xt.select("id", mean.alias("p")), {}
    if name == "rank_mean":
        if problem_type != "binary":
            raise ValueError("rank_mean is for binary tasks")
        o = oof_long.join(train.select("id", "fold"), "id")
        oof = materialize(BL.rank_mean(o, ["fold"]).join(train.select("id", "y"), "id"))
        test = BL.rank_mean(test_long.withColumn("_set", F.lit(0)), ["_set"]).drop("_set")
        return oof.select("id", "fold", "y", "p"), test.select("id", "p"), {}
    X = train_matrix(oof_long, train, members) if matrix is None else matrix
    Xt = member_matrix(test_long, members)
    if name == "linear":
        if problem_type != "regression":
            raise ValueError("linear meta is for regression tasks")
        S = SV.fold_moments(X, members, "y", "fold", n_folds)
        B = np.array([SV.ols_fit(S[q], M) for q in range(n_folds + 1)])
        pred = SV.per_fold_expr("fold", n_folds, lambda q: SV.linear_expr(members, B[q][1:], B[q][0]))
        tpred = SV.linear_expr(members, B[n_folds][1:], B[n_folds][0])
        detail = {"coef": B}
    elif name == "logistic":
        if problem_type != "binary":
            raise ValueError("logistic meta is for binary tasks")
        zs = [f"_z_{m}" for m in members]
        Xz = X.select("id", "fold", "y", *[logit(m).alias(z) for m, z in zip(members, zs)])
        B, grad, passes = SV.logistic_fit(Xz, zs, "y", "fold", n_folds, C=1.0)
        lz = {m: logit(m) for m in members}

        def pr(q):
            z = F.lit(float(B[q][0]))
            for m, c in zip(members, B[q][1:]):
                z = z + F.lit(float(c)) * lz[m]
            return _sigmoid(z)
        pred = SV.per_fold_expr("fold", n_folds, pr)
        tpred = pr(n_folds)
        detail = {"coef": B, "grad": grad, "passes": passes}
    elif name == "nnls":
        if problem_type == "regression":
            S = SV.fold_moments(X, members, "y", "fold", n_folds)
            W = np.array([SV.mse_simplex_fit(S[q], M) for q in range(n_folds + 1)])
            detail = {"weights": W}
        else:
            W, loss, grad, passes = SV.convex_logloss_fit(X, members, "y", "fold", n_folds, kind="binary")
            detail = {"weights": W, "loss": loss, "grad": grad, "passes": passes}
        pred = SV.per_fold_expr("fold", n_folds, lambda q: SV.linear_expr(members, W[q]))
        tpred = SV.linear_expr(members, W[n_folds])
    else:
        raise ValueError(f"unknown meta {name!r}")
    oof = X.select("id", "fold", "y", pred.alias("p"))
    test = Xt.select("id", tpred.alias("p"))
    return oof, test, detail


def _true_class_matrix(oof_long: DataFrame, train: DataFrame, members: list[str]) -> DataFrame:
    t = oof_long.join(train.select("id", "code"), "id").select(
        "member", "id", F.element_at("probs", F.col("code") + 1).alias("_py"))
    return member_matrix(t, members, p="_py").join(train.select("id", "fold", "code"), "id")


def meta_multiclass(name: str, oof_long: DataFrame, test_long: DataFrame, train: DataFrame, members: list[str],
                    n_folds: int, n_classes: int) -> tuple[DataFrame, DataFrame, dict]:
    K = n_classes
    if name == "equal":
        oof = BL.mc_blend_equal(oof_long, K).join(train.select("id", "fold", "code"), "id")
        return oof, BL.mc_blend_equal(test_long, K), {}
    if name == "nnls":
        X = _true_class_matrix(oof_long, train, members).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            W, loss, grad, passes = SV.convex_logloss_fit(X, members, None, "fold", n_folds, kind="true_class")
        finally:
            X.unpersist()
        o = oof_long.join(train.select("id", "fold", "code"), "id")
        w = F.lit(0.0)
        for q in range(n_folds):
            for j, m in enumerate(members):
                w = F.when((F.col("fold") == q) & (F.col("member") == m), F.lit(float(W[q][j]))).otherwise(w)
        agg = o.groupBy("id", "fold", "code").agg(
            *[F.sum(w * F.element_at("probs", k + 1)).alias(f"_b{k}") for k in range(K)])
        s = sum((F.col(f"_b{k}") for k in range(K)), F.lit(0.0))
        oof = agg.select("id", "fold", "code", F.array(*[F.try_divide(F.col(f"_b{k}"), s) for k in range(K)]).alias("probs"))
        test = BL.mc_weighted_blend(test_long, dict(zip(members, W[n_folds])), K)
        return oof, test, {"weights": W, "loss": loss, "grad": grad, "passes": passes}
    if name == "multinomial":
        return _multinomial(oof_long, test_long, train, members, n_folds, K)
    raise ValueError(f"unknown meta {name!r}")


def _multinomial(oof_long, test_long, train, members, n_folds, K):
    """L2 multinomial logistic (C=1) on the M*K raw probabilities, all folds in shared passes."""

    def wide(long):
        parts = [F.first(F.when(F.col("member") == m, F.col("probs")), ignorenulls=True).alias(f"_a{i}")
                 for i, m in enumerate(members)]
        w = long.groupBy("id").agg(*parts)
        return w.select("id", F.concat(*[f"_a{i}" for i in range(len(members))]).alias("features"))

    X = materialize(wide(oof_long).join(train.select("id", "fold", "code"), "id"))  # read by every pass and the prediction
    B, obj, grad, passes = SV.multinomial_fit(X, "features", len(members) * K, "code", K, "fold", n_folds, stored=True)
    oof = SV.multinomial_predict(X, B, "features", ["id", "fold", "code"], "fold")
    test = SV.multinomial_predict(wide(test_long), B, "features", ["id"], n_folds)
    return oof, test, {"coef": B, "objective": obj, "grad": grad, "passes": passes}


def score_oof(oof: DataFrame, metric: str, problem_type: str) -> float:
    mc = problem_type == "multiclass"
    y = "code" if mc else "y"
    p = "probs" if mc else "p"
    row = MT.score(oof, metric, [], y=y, p=p, multiclass=mc).first()
    return float(row[0]) if row[0] is not None else float("nan")


@dataclass
class StackResult:
    scores: list[tuple[str, float]]
    best: MetaResult
    weights: dict
    regime: str
    metas: dict


def stack(oof_long: DataFrame, test_long: DataFrame, train: DataFrame, members: list[str], n_folds: int,
          problem_type: str, metric: str, regime: str, n_classes: int | None = None,
          metas: tuple[str, ...] | None = None) -> StackResult:
    """Score every meta by its OOF, pick the best by the metric direction,
    and report the full-data convex weights."""
    names = metas or METAS[problem_type]
    oof_long, test_long, train = materialize(oof_long), materialize(test_long), materialize(train)
    matrix = None if problem_type == "multiclass" else train_matrix(oof_long, train, members)
    results = {}
    for name in names:
        if problem_type == "multiclass":
            oof, test, det = meta_multiclass(name, oof_long, test_long, train, members, n_folds, n_classes)
        else:
            oof, test, det = meta_binary_or_regression(name, oof_long, test_long, train, members, n_folds, problem_type, matrix)
        results[name] = MetaResult(name, oof, test, score_oof(oof, metric, problem_type), det)
    better = greater_is_better(metric)
    ordered = sorted(results.values(), key=lambda r: r.oof_score, reverse=better)
    best = ordered[0]
    full_w = results["nnls"].detail.get("weights") if "nnls" in results else None
    weights = {m: round(float(w), 4) for m, w in zip(members, full_w[n_folds])} if full_w is not None else {}
    return StackResult([(r.name, r.oof_score) for r in ordered], best, weights, regime, results)


@dataclass
class StackJob:
    result: StackResult
    member_scores: DataFrame
    correlation: DataFrame | None
    oof_table: DataFrame
    test_table: DataFrame
    log: DataFrame


def stack_job(spark, oof_long: DataFrame, test_long: DataFrame, train: DataFrame, template_ids: DataFrame,
              members: list[str], spec, raw_logs: DataFrame | None = None, tag: str = "stack",
              n_classes: int | None = None, classes: list | None = None, split_store: str | None = None,
              allow_fallback: bool = False) -> StackJob:
    """Align -> resolve the members' regime -> member scores and correlation -> metas
    -> best by direction -> contract tables (the stack is itself a valid member) -> log.

    With ``raw_logs`` the folds are those of the members' logged regime: loaded from
    ``split_store`` if given, else the fold column of ``train`` must be that split.
    """
    from foldwise.operators import integrity as IG
    from foldwise.operators import members as MM
    from foldwise.operators import runs as RU

    oof_long, test_long = materialize(oof_long), materialize(test_long)
    MM.check_alignment(MM.alignment_report(oof_long, train.select("id"), members))
    MM.check_alignment(MM.alignment_report(test_long, template_ids, members))
    n_folds = spec.n_folds
    regime = spec.cv_label()
    if raw_logs is not None:
        r = RU.resolve_regime(raw_logs, members, (spec.cv_strategy, spec.n_folds)).first()
        strategy, n_folds = RU.check_regime(r, allow_fallback)
        regime = f"{strategy}_{n_folds}"
        if split_store is not None:
            key = IG.split_regime(train, replace(spec, cv_strategy=strategy), n_folds)
            train = IG.attach_split(train.drop("fold"), IG.load_split(spark, split_store, key, train, y_col="y"))
    top = train.agg(F.max("fold").alias("m")).first()["m"]
    if top != n_folds - 1:
        raise ValueError(f"the fold column ends at {top}, the regime {regime} has {n_folds} folds; pass its split")
    mc = spec.problem_type == "multiclass"
    y = "code" if mc else "y"
    o = oof_long.join(train.select("id", y), "id")
    ms = MT.score(o, spec.metric, ["member"], y=y, p="probs" if mc else "p", multiclass=mc, out="score")
    corr = None if mc else MM.correlation(member_matrix(oof_long, members), members)
    res = stack(oof_long, test_long, train, members, n_folds, spec.problem_type, spec.metric, regime,
                n_classes=n_classes)
    best = res.best
    name = f"{tag}_{best.name}"
    if mc:
        from foldwise.plans.oof import probs_wide
        oof_tab = probs_wide(best.oof, classes, "oof_")
        test_tab = probs_wide(best.test, [str(c) for c in classes], "")
    else:
        oof_tab = best.oof.select("id", F.col("p").alias("oof"))
        test_tab = best.test.select("id", F.col("p").alias(spec.target_col))
    params = {"seed": spec.seed, "feature_recipe": None, "members": members, "meta_winner": best.name,
              "meta_oof": {n: round(float(s), 6) for n, s in res.scores}, "nnls_weights": res.weights}
    runs = spark.createDataFrame(
        [(name, f"stack:{best.name}", members, regime, params, f"stack over {len(members)} members; meta={best.name}")],
        "exp_id string, model string, features array<string>, cv_strategy string, params "
        + RU.PARAMS.simpleString() + ", notes string")
    scores = spark.createDataFrame([(name, 0, float(best.oof_score))], "exp_id string, fold int, score double")
    log = RU.log_records(scores, runs, iter_col=None)
    return StackJob(res, ms, corr, oof_tab, test_tab, log)
