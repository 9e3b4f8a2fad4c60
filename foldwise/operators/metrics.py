"""Metrics as grouped aggregates: one job scores every fold/member/run.

All take a long table with the grouping ``keys``, a target and a
prediction, and return one row per key combination. AUC is exact (ties
count one half): predictions are exchanged once by value ranges, scanned in
order, and the counts of negatives carried over the tasks' boundaries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.functions.scalar import LOGLOSS_EPS, argmax_code, clip, hard_label
from foldwise.operators.scan import pair_statistic

DIRECTIONS = {"auc": True, "logloss": False, "rmse": False, "mae": False, "accuracy": True,
              "balanced_accuracy": True}


def auc(df: DataFrame, keys: Sequence[str] = (), y: str = "y", p: str = "p", out: str = "auc",
        degenerate: str | None = None) -> DataFrame:
    """Area under the ROC curve per key; NULL when a group has one class. ``degenerate`` names a
    flag of such groups. Every prediction is exchanged once (see operators.scan)."""
    K = list(keys)
    spread = [c for c in ("id",) if c in df.columns]  # equal predictions differ by their key
    rows = df.select(*dict.fromkeys([*K, p, *spread]), F.col(y).cast("long").alias("_pos"), (1 - F.col(y)).cast("long").alias("_neg"))
    res = pair_statistic(rows, K, p, low="_neg", high="_pos", spread_by=[*spread, "_pos"] if spread else ())
    one_class = (F.col("n_low") == 0) | (F.col("n_high") == 0)
    val = F.when(~one_class, F.col("pairs") / (F.col("n_high") * F.col("n_low")))
    return res.select(*K, val.alias(out), *([one_class.alias(degenerate)] if degenerate else []))


def _binary_logloss(y: Column, p: Column) -> Column:
    c = clip(p, LOGLOSS_EPS, 1 - LOGLOSS_EPS)
    return -(y * F.ln(c) + (1 - y) * F.ln(1 - c))


def logloss(df: DataFrame, keys: Sequence[str] = (), y: str = "y", p: str = "p", out: str = "logloss") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(_binary_logloss(F.col(y), F.col(p))).alias(out))


def mc_logloss(df: DataFrame, keys: Sequence[str] = (), y: str = "code", probs: str = "probs",
               out: str = "logloss") -> DataFrame:
    """Multiclass log loss over an array of K probabilities; all K labels count."""
    c = F.transform(probs, lambda x: clip(x, LOGLOSS_EPS, 1 - LOGLOSS_EPS))
    s = F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    py = F.element_at(c, F.col(y) + 1) / s
    return df.groupBy(*keys).agg(F.avg(-F.ln(py)).alias(out))


def rmse(df: DataFrame, keys: Sequence[str] = (), y: str = "y", p: str = "p", out: str = "rmse") -> DataFrame:
    return df.groupBy(*keys).agg(F.sqrt(F.avg(F.pow(F.col(y) - F.col(p), 2))).alias(out))


def mae(df: DataFrame, keys: Sequence[str] = (), y: str = "y", p: str = "p", out: str = "mae") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(F.abs(F.col(y) - F.col(p))).alias(out))


def _pred_label(p: str, multiclass: bool) -> Column:
    return argmax_code(p) if multiclass else hard_label(p)


def accuracy(df: DataFrame, keys: Sequence[str] = (), y: str = "y", p: str = "p", multiclass: bool = False,
             out: str = "accuracy") -> DataFrame:
    hit = (_pred_label(p, multiclass) == F.col(y)).cast("double")
    return df.groupBy(*keys).agg(F.avg(hit).alias(out))


def balanced_accuracy(df: DataFrame, keys: Sequence[str] = (), y: str = "y", p: str = "p",
                      multiclass: bool = True, out: str = "balanced_accuracy") -> DataFrame:
    """Macro mean of per-class recall over the classes present in y."""
    hit = (_pred_label(p, multiclass) == F.col(y)).cast("double")
    rec = df.groupBy(*keys, y).agg(F.avg(hit).alias("_recall"))
    return rec.groupBy(*keys).agg(F.avg("_recall").alias(out))


def score(df: DataFrame, metric: str, keys: Sequence[str] = (), y: str = "y", p: str = "p",
          multiclass: bool = False, out: str = "score") -> DataFrame:
    """Dispatch by metric name (binary/regression: column p; multiclass: array p)."""
    m = metric.lower()
    if m == "auc":
        return auc(df, keys, y, p, out)
    if m == "logloss":
        return mc_logloss(df, keys, y, p, out) if multiclass else logloss(df, keys, y, p, out)
    if m == "rmse":
        return rmse(df, keys, y, p, out)
    if m == "mae":
        return mae(df, keys, y, p, out)
    if m == "accuracy":
        return accuracy(df, keys, y, p, multiclass, out)
    if m == "balanced_accuracy":
        return balanced_accuracy(df, keys, y, p, multiclass, out)
    raise ValueError(f"unknown metric {metric!r}; known {sorted(DIRECTIONS)}")


def cv_summary(fold_scores: DataFrame, keys: Sequence[str] = (), score_col: str = "score") -> DataFrame:
    """Mean and population std (ddof=0) of fold scores, rounded to 6 digits."""
    return fold_scores.groupBy(*keys).agg(
        F.round(F.avg(score_col), 6).alias("cv_mean"),
        F.round(F.stddev_pop(score_col), 6).alias("cv_std"),
        F.count(F.lit(1)).alias("n_folds"),
    )
