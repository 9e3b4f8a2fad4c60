"""Integrity checks: split tables, fold-input fingerprints, row counts."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.sources.stored import AlreadyPublished, publish, published
from foldwise.spec import TaskSpec


# ------------------------------------------------------------------ split tables
def content_hash(df: DataFrame, cols: Sequence[str]) -> str:
    """Order-free hash of a row set: sha2 over its count, xor and sum of row hashes.

    Computed by Spark alone, so every session and process gets the same value.
    """
    h = F.xxhash64(*[F.col(c) for c in cols])
    parts = F.concat_ws(":", F.count(F.lit(1)), F.coalesce(F.bit_xor(h), F.lit(0)),
                        F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")))
    return df.agg(F.substring(F.sha2(parts, 256), 1, 16).alias("h")).first()["h"]


def split_regime(train: DataFrame, spec: TaskSpec, n_folds: int | None = None) -> dict:
    """What a stored split is found by. Group splits depend on which rows share a group, so they
    also carry the hash of the (id, group) set."""
    grouped = spec.cv_strategy == "GroupKFold"
    return {"strategy": spec.cv_strategy, "n_folds": n_folds or spec.n_folds, "seed": spec.seed,
            "groups": content_hash(train, [spec.id_col, *spec.group_keys]) if grouped else "none"}


def split_name(regime: dict) -> str:
    """Name of a regime's table in the store."""
    return "split-" + hashlib.sha256(json.dumps(regime, sort_keys=True).encode()).hexdigest()[:24]


def read_split(spark: SparkSession, store: str, regime: dict) -> DataFrame | None:
    """The stored split of a regime, or None when it is not published yet."""
    return published(spark, store, split_name(regime))


def split_table(folded: DataFrame, id_col: str = "id", y_col: str = "y", fold_col: str = "fold") -> DataFrame:
    """(id, fold, y_fp): the fold per key plus a target fingerprint (detects a changed target)."""
    return folded.select(id_col, F.col(fold_col).cast("int").alias("fold"), F.xxhash64(F.col(y_col)).alias("y_fp"))


def save_split(split: DataFrame, store: str, regime: dict, id_col: str = "id") -> None:
    """Publish a split, once; refuse a split with a row in no fold."""
    if split.where(F.col("fold").isNull()).limit(1).count():
        raise ValueError("some rows are in no validation fold; not a partition, not written")
    publish(split, store, split_name(regime), id_col, regime)


def split_report(split: DataFrame, data: DataFrame, n_folds: int, id_col: str = "id", y_col: str = "y") -> DataFrame:
    """One row: counts, fold label range, id set differences and target changes."""
    s = split.select(F.col(id_col).alias("_sid"), "fold", "y_fp")
    d = data.select(F.col(id_col).alias("_did"), F.xxhash64(F.col(y_col)).alias("_dfp"))
    j = s.join(d, s["_sid"] == d["_did"], "full_outer")
    return j.agg(
        F.count("_sid").alias("n_split"), F.count("_did").alias("n_data"),
        F.min("fold").alias("min_fold"), F.max("fold").alias("max_fold"),
        F.countDistinct("fold").alias("n_labels"),
        F.count_if(F.col("_did").isNull()).alias("n_extra"), F.count_if(F.col("_sid").isNull()).alias("n_missing"),
        F.count_if(F.col("_sid").isNotNull() & F.col("_did").isNotNull() & (F.col("y_fp") != F.col("_dfp")))
        .alias("n_target_changed"),
    ).withColumn("ok", (F.col("n_split") == F.col("n_data")) & (F.col("min_fold") == 0)
                 & (F.col("max_fold") == n_folds - 1) & (F.col("n_labels") == n_folds)
                 & (F.col("n_extra") == 0) & (F.col("n_missing") == 0) & (F.col("n_target_changed") == 0))


def load_split(spark: SparkSession, store: str, regime: dict, data: DataFrame, id_col: str = "id",
               y_col: str = "y") -> DataFrame:
    """Read a stored split and self-check it; on mismatch fail, never regenerate."""
    split = read_split(spark, store, regime)
    if split is None:
        raise ValueError(f"no split stored for {regime}")
    rep = split_report(split, data, regime["n_folds"], id_col, y_col).first()
    if not rep["ok"]:
        raise ValueError(f"the split stored for {regime} does not match the data: {rep.asDict()}; "
                         "delete it deliberately to regenerate")
    return split.select(id_col, "fold")


def get_or_create_split(spark: SparkSession, train: DataFrame, spec: TaskSpec, store: str,
                        n_folds: int | None = None) -> DataFrame:
    """Load the split of this regime if stored, else assign folds and publish them. Of several
    processes that do so at once one publishes, and all go on with its split."""
    from foldwise.operators.folds import assign_folds

    n = n_folds or spec.n_folds
    regime = split_regime(train, spec, n)
    if read_split(spark, store, regime) is None:
        narrow = train.select(*dict.fromkeys([spec.id_col, spec.target_col, *spec.group_keys]))
        split = split_table(assign_folds(narrow, spec, n), spec.id_col, spec.target_col)
        try:
            save_split(split, store, regime, spec.id_col)
        except AlreadyPublished:
            pass  # another process was first: its split is the one
    return load_split(spark, store, regime, train, spec.id_col, spec.target_col)


def attach_split(data: DataFrame, split: DataFrame, id_col: str = "id") -> DataFrame:
    """Key join of the stored fold onto the data (never by position)."""
    return data.join(split.select(id_col, "fold"), id_col, "inner")


# ------------------------------------------------------------------ fingerprints
def row_hash_md5(cols: Sequence[str]) -> Column:
    """Per-row integer hash: first 8 hex digits of md5 over the sorted column values."""
    parts = []
    for c in sorted(cols):
        parts += [F.lit(c), F.lit("="), F.coalesce(F.col(c).cast("string"), F.lit("\\N")), F.lit(";")]
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 8), 16, 10).cast("bigint")


def fingerprint(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Order-free content fingerprint per key: count, xor and sum of row hashes.

    xor alone cancels duplicated rows, the sum does not; columns are taken
    in sorted name order so a column reorder does not change it.
    """
    h = row_hash_md5(cols)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"),
                                 F.sum(h).alias("s"))


def fingerprint_diff(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose fingerprint differs (or exists on one side only)."""
    j = a.alias("a").join(b.alias("b"), list(keys), "full_outer")
    same = ((F.col("a.n") == F.col("b.n")) & (F.col("a.x") == F.col("b.x")) & (F.col("a.s") == F.col("b.s")))
    return j.where(~F.coalesce(same, F.lit(False))).select(
        *keys, F.col("a.n").alias("n_before"), F.col("b.n").alias("n_after"))


def check_row_count(df: DataFrame, expected: int, what: str = "table") -> int:
    n = df.count()
    if n != expected:
        raise ValueError(f"{what}: {n} rows, expected {expected}")
    return n
