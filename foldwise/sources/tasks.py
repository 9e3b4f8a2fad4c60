"""Keyed task tables derived from the driver tables.

Every task table has ``id`` (unique key), ``y`` (target), its feature
columns and ``part`` in {train, test, source}: test = u(part) >= 0.8,
source (augmentation rows) = 0.7 <= u(part) < 0.8, train = the rest.
Folds are assigned on train rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.functions.scalar import uniform
from foldwise.sources.tables import read_table
from foldwise.spec import TaskSpec


def part_of(id_col: str | Column = "id") -> Column:
    u = uniform(id_col, "part")
    return F.when(u >= 0.8, F.lit("test")).when(u >= 0.7, F.lit("source")).otherwise(F.lit("train"))


def bin_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: is the event a purchase? category user_id, numeric value."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    return ev.select(
        F.col("event_id").alias("id"),
        (F.col("event_type") == "purchase").cast("int").alias("y"),
        "user_id", "value", "ts",
        part_of("event_id").alias("part"),
    )


def syn_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with a planted signal: y = 0.7 u(a) + 0.3 u(n) > 0.5."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "value"])
    y = ((F.lit(0.7) * uniform("event_id", "a") + F.lit(0.3) * uniform("event_id", "n")) > 0.5).cast("int")
    return ev.select(
        F.col("event_id").alias("id"), y.alias("y"), "user_id", "value", "ts",
        part_of("event_id").alias("part"),
    )


def reg_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders: regress o_totalprice; high-cardinality o_custkey."""
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus"])
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("y"),
        "o_custkey", "o_orderdate", "o_orderstatus",
        part_of("o_orderkey").alias("part"),
    )


def mc_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders: classify o_orderpriority (5 labels)."""
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice"])
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("y"),
        "o_orderstatus", "o_totalprice",
        part_of("o_orderkey").alias("part"),
    )


def imb_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels joined to documents: toxic (imbalanced), lang, source, n_chars."""
    lab = read_table(spark, sf_dir, "labels", ["doc_id", "toxic"])
    doc = read_table(spark, sf_dir, "documents", ["doc_id", "lang", "source", "n_chars"])
    return lab.join(doc, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("toxic").alias("y"), "lang", "source", "n_chars",
        part_of("doc_id").alias("part"),
    )


def vec_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings: 10-class label from a 64-d vector."""
    e = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    return e.select(
        F.col("vec_id").alias("id"), F.col("label").alias("y"), "embedding",
        part_of("vec_id").alias("part"),
    )


def train_rows(task: DataFrame) -> DataFrame:
    return task.where(F.col("part") == "train").drop("part")


def test_rows(task: DataFrame) -> DataFrame:
    return task.where(F.col("part") == "test").drop("part")


def source_rows(task: DataFrame) -> DataFrame:
    """Augmentation rows: features + target, no id."""
    return task.where(F.col("part") == "source").drop("part", "id")


SPECS = {
    "bin": TaskSpec(problem_type="binary", metric="auc", cv_strategy="StratifiedKFold",
                    categorical_cols=("user_id",), numeric_cols=("value",), group_keys=("user_id",),
                    sequence_col="ts", te_cols=("user_id",)),
    "syn": TaskSpec(problem_type="binary", metric="auc", cv_strategy="StratifiedKFold",
                    numeric_cols=("value",), group_keys=("user_id",), sequence_col="ts"),
    "grp": TaskSpec(problem_type="binary", metric="auc", cv_strategy="GroupKFold",
                    categorical_cols=("user_id",), numeric_cols=("value",), group_keys=("user_id",),
                    sequence_col="ts", te_cols=("user_id",)),
    "reg": TaskSpec(problem_type="regression", metric="rmse", cv_strategy="KFold",
                    categorical_cols=("o_orderstatus",), group_keys=("o_custkey",), sequence_col="o_orderdate",
                    te_cols=("o_custkey",)),
    "mc": TaskSpec(problem_type="multiclass", metric="logloss", cv_strategy="StratifiedKFold",
                   categorical_cols=("o_orderstatus",), numeric_cols=("o_totalprice",)),
    "imb": TaskSpec(problem_type="binary", metric="auc", cv_strategy="StratifiedKFold",
                    categorical_cols=("lang", "source"), numeric_cols=("n_chars",)),
    "vec": TaskSpec(problem_type="multiclass", metric="accuracy", cv_strategy="StratifiedKFold"),
}

BUILDERS = {"bin": bin_task, "syn": syn_task, "grp": bin_task, "reg": reg_task, "mc": mc_task,
            "imb": imb_task, "vec": vec_task}


def load_task(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, TaskSpec]:
    return BUILDERS[name](spark, sf_dir), SPECS[name]


def with_planted_features(task: DataFrame) -> DataFrame:
    """Binary planted-signal features: s_a carries the signal of y, s_n is noise."""
    return task.withColumn("s_a", uniform("id", "a")).withColumn("s_n", uniform("id", "m2"))


def with_order_features(spark: SparkSession, sf_dir: str, task: DataFrame) -> DataFrame:
    """Regression features: line count and net value of the order's lineitems (aggregate +
    key join), plus a planted noisy hint of the target."""
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_extendedprice", "l_discount", "l_tax"])
    agg = li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("net_value"))
    out = task.join(agg, task["id"] == agg["l_orderkey"], "left").drop("l_orderkey")
    return out.withColumn("hint", F.col("y") * (0.8 + 0.4 * uniform("id", "m1")))
