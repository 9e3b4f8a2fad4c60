"""Fold assignment as a keyed table ``(id, fold)``.

* StratifiedKFold: fold = (rank over (class, md5(id:seed), id) - 1) mod n;
  per class the fold sizes differ by at most one.
* KFold: the same without the class.
* GroupKFold: groups ranked by (size desc, md5(key), key) and dealt
  round-robin; a group never spans folds; no seed.

Ranks are computed by the two-level rank (hash-prefix buckets), so no step
puts all rows, or all rows of one class, into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.operators.rank import default_hex_digits, global_row_number
from foldwise.spec import TaskSpec


def seeded_hash(id_col: str, *salt) -> Column:
    """md5 of ``<id>:<salt>...`` as hex text (identical in any engine)."""
    parts = [F.col(id_col).cast("string")]
    for s in salt:
        parts += [F.lit(":"), s.cast("string") if isinstance(s, Column) else F.lit(str(s))]
    return F.md5(F.concat(*parts))


def group_hash_key(keys: Sequence[str]) -> Column:
    """Tie-break hash of a composite group key.

    Only orders groups of equal size; grouping itself is on the key columns
    (struct semantics), so a separator collision can never merge two groups.
    """
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))


def rank_folds(
    df: DataFrame,
    n_folds: int,
    *,
    seed: int,
    id_col: str = "id",
    strata: str | None = None,
    partition_by: Sequence[str] = (),
    salt: Sequence = (),
    fold_col: str = "fold",
    digits: int | None = None,
) -> DataFrame:
    """Add ``fold`` = (row number over (strata, md5(id:seed[:salt]), id) - 1) mod n.

    ``partition_by`` ranks independently inside each partition (used by the
    inner folds of nested encoding, partitioned by outer fold k).
    """
    digits = digits or default_hex_digits(df.sparkSession)
    tmp = df.withColumn("_hb", F.substring(seeded_hash(id_col, seed, *salt), 1, digits))
    bucket = ([strata] if strata else []) + ["_hb"]
    # the full hash is recomputed after the exchange as the sort key (not shuffled)
    ranked = global_row_number(tmp, bucket=bucket, order=[seeded_hash(id_col, seed, *salt), F.col(id_col)],
                               partition_by=partition_by, out="_rn")
    return ranked.withColumn(fold_col, ((F.col("_rn") - 1) % n_folds).cast("int")).drop("_hb", "_rn")


def group_folds(
    df: DataFrame,
    n_folds: int,
    group_keys: Sequence[str],
    *,
    partition_by: Sequence[str] = (),
    fold_col: str = "fold",
    digits: int | None = None,
) -> DataFrame:
    """Group k-fold: whole groups per fold, balanced by dealing large groups first.

    A NULL key is one shared group (as the modelled toolkit's text key does).
    """
    if not group_keys:
        raise ValueError("group folds need group keys")
    missing = [k for k in group_keys if k not in df.columns]
    if missing:
        raise ValueError(f"group keys missing from the table: {missing}")
    P, G = list(partition_by), list(group_keys)
    sizes = df.groupBy(*P, *G).agg(F.count(F.lit(1)).alias("_gn"))
    gf = deal_groups(sizes, "_gn", n_folds, G, partition_by=P, fold_col=fold_col, digits=digits)
    cond = [df[c] == gf[c] for c in P] + [df[k].eqNullSafe(gf[k]) for k in G]
    return df.join(gf, cond, "inner").select(df["*"], gf[fold_col])


def deal_groups(sizes: DataFrame, size_col: str, n_folds: int, group_keys: Sequence[str], *, partition_by: Sequence[str] = (),
                fold_col: str = "fold", digits: int | None = None) -> DataFrame:
    """(partition, group, fold) from a table of one row per group: dealt round-robin by size, then hash, then key."""
    digits = digits or default_hex_digits(sizes.sparkSession)
    P, G = list(partition_by), list(group_keys)
    sizes = (
        sizes.withColumn("_neg_n", -F.col(size_col))
        .withColumn("_gh", group_hash_key(G))
        .withColumn("_ghb", F.substring("_gh", 1, digits))
    )
    # groups before this size, over the few distinct sizes; then the rank within the size
    before = Window.partitionBy(*P).orderBy("_neg_n").rowsBetween(Window.unboundedPreceding, -1)
    by_size = sizes.groupBy(*P, "_neg_n").agg(F.count(F.lit(1)).alias("_m")).select(
        *P, "_neg_n", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_larger"))
    ranked = global_row_number(
        sizes, bucket=["_ghb"], order=["_gh", *[F.col(k).asc_nulls_first() for k in G]],
        partition_by=[*P, "_neg_n"], out="_grn",
    ).join(by_size, [*P, "_neg_n"])
    return ranked.select(*P, *G, ((F.col("_larger") + F.col("_grn") - 1) % n_folds).cast("int").alias(fold_col))


def assign_folds(train: DataFrame, spec: TaskSpec, n_folds: int | None = None) -> DataFrame:
    """Fold per train row for the task's CV strategy: ``train`` + ``fold``."""
    n = n_folds or spec.n_folds
    if spec.cv_strategy == "StratifiedKFold":
        return rank_folds(train, n, seed=spec.seed, id_col=spec.id_col, strata=spec.target_col)
    if spec.cv_strategy == "KFold":
        return rank_folds(train, n, seed=spec.seed, id_col=spec.id_col)
    if spec.cv_strategy == "GroupKFold":
        return group_folds(train, n, spec.group_keys)
    raise ValueError(f"unknown CV strategy {spec.cv_strategy!r}")


def fold_slice(folded: DataFrame, k: int, fold_col: str = "fold") -> tuple[DataFrame, DataFrame]:
    """(train part, validation part) of outer fold k: fold != k / fold = k."""
    return folded.where(F.col(fold_col) != k), folded.where(F.col(fold_col) == k)


def screening_folds(folded: DataFrame, max_folds: int, fold_col: str = "fold") -> DataFrame:
    """Validation rows of the first ``max_folds`` folds of the same split."""
    return folded.where(F.col(fold_col) < max_folds)
