"""Multiclass label map: sorted distinct raw labels <-> codes 0..K-1."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_CLASSES = 10_000


@dataclass
class LabelMap:
    classes: list
    table: DataFrame  # (label, code), K rows

    @property
    def n_classes(self) -> int:
        return len(self.classes)

    def encode(self, df: DataFrame, y: str = "y", out: str = "code") -> DataFrame:
        """Codes of the labels. A null label has none; a label outside the map is an error,
        raised by the rows that hold it."""
        table = self.table.select(F.col("label").alias("_label"), "code")
        coded = df.join(F.broadcast(table), df[y] == F.col("_label"), "left").drop("_label")
        unseen = F.raise_error(F.concat(F.lit("label outside the fitted label map: "), F.col(y).cast("string")))
        coded = coded.withColumn("code", F.when(F.col("code").isNull() & F.col(y).isNotNull(), unseen.cast("int"))
                                 .otherwise(F.col("code")))
        return coded.withColumnRenamed("code", out) if out != "code" else coded

    def decode(self, df: DataFrame, code: str = "code", out: str = "label") -> DataFrame:
        t = self.table.select(F.col("code").alias("_code"), F.col("label").alias(out))
        return df.join(F.broadcast(t), df[code] == t["_code"], "left").drop("_code")


def fit_label_map(spark: SparkSession, df: DataFrame, y: str = "y", n_classes: int | None = None) -> LabelMap:
    """Distinct labels (bounded: at most MAX_CLASSES) sorted on the driver."""
    rows = df.select(y).where(F.col(y).isNotNull()).distinct().limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} distinct labels; not a multiclass target")
    classes = sorted(r[0] for r in rows)
    if n_classes is not None and n_classes != len(classes):
        raise ValueError(f"declared n_classes={n_classes} but the train target has {len(classes)} labels")
    dtype = df.schema[y].dataType
    schema = T.StructType([T.StructField("label", dtype, False), T.StructField("code", T.IntegerType(), False)])
    table = spark.createDataFrame([(c, i) for i, c in enumerate(classes)], schema)
    return LabelMap(classes=classes, table=table)
