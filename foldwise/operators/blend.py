"""Blends of member prediction tables.

Members arrive in long form ``(member, id, p)`` (binary / regression) or
``(member, id, probs)`` (multiclass). A blend never aligns rows by position:
all combining is a group-by on ``id`` or a join on keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.operators.scan import average_ranks


def blend_equal(members: DataFrame, id_col: str = "id", p: str = "p", out: str = "p") -> DataFrame:
    """Mean of the member predictions per id."""
    return members.groupBy(id_col).agg(F.avg(p).alias(out))


def average_rank(df: DataFrame, set_keys: Sequence[str], p: str = "p", out: str = "rank") -> DataFrame:
    """Average rank (ties share the mean rank, 1-based) of ``p`` inside each set, by one ordered scan."""
    return average_ranks(df, set_keys, p, out)


def rank_mean(members: DataFrame, set_keys: Sequence[str], id_col: str = "id", member_col: str = "member",
              p: str = "p", out: str = "p") -> DataFrame:
    """Mean over members of rank / n inside the evaluated set (a fold or the test set)."""
    K = list(set_keys)
    r = average_rank(members, [*K, member_col], p, out="_rank")
    n = members.groupBy(*K, member_col).agg(F.count(F.lit(1)).alias("_n"))
    r = r.join(n, [*K, member_col]).withColumn("_rr", F.col("_rank") / F.col("_n"))
    # rounded to 12 digits: equal rank means must tie whatever the addition order
    return r.groupBy(*K, id_col).agg(F.round(F.avg("_rr"), 12).alias(out))


def mc_blend_equal(members: DataFrame, n_classes: int, id_col: str = "id", probs: str = "probs",
                   out: str = "probs") -> DataFrame:
    """Mean of member probability rows, renormalised to sum 1."""
    avg = members.groupBy(id_col).agg(
        *[F.avg(F.element_at(probs, k + 1)).alias(f"_a{k}") for k in range(n_classes)]
    )
    s = sum((F.col(f"_a{k}") for k in range(n_classes)), F.lit(0.0))
    return avg.select(id_col, F.array(*[F.try_divide(F.col(f"_a{k}"), s) for k in range(n_classes)]).alias(out))


def mc_weighted_blend(members: DataFrame, weights: dict[str, float], n_classes: int, id_col: str = "id",
                      member_col: str = "member", probs: str = "probs", out: str = "probs") -> DataFrame:
    """Member-weighted probability rows, renormalised (clipping belongs to the loss only)."""
    w = F.lit(0.0)
    for m, x in weights.items():
        w = F.when(F.col(member_col) == m, F.lit(float(x))).otherwise(w)
    agg = members.groupBy(id_col).agg(*[F.sum(w * F.element_at(probs, k + 1)).alias(f"_b{k}") for k in range(n_classes)])
    s = sum((F.col(f"_b{k}") for k in range(n_classes)), F.lit(0.0))
    arr = F.array(*[F.try_divide(F.col(f"_b{k}"), s) for k in range(n_classes)])
    return agg.select(id_col, arr.alias(out))
