"""File sources and sinks of the prediction contract (parquet first, CSV fallback)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def check_columns(df_or_names) -> None:
    """Spark resolves column names case-insensitively: reject names equal up to case."""
    names = df_or_names if isinstance(df_or_names, (list, tuple)) else df_or_names.columns
    seen: dict[str, str] = {}
    for n in names:
        low = n.lower()
        if low in seen:
            raise ValueError(f"columns {seen[low]!r} and {n!r} differ only in case")
        seen[low] = n


def nan_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing values as NULL: NaN in float columns becomes NULL."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    targets = [c for c in (cols or floats) if c in floats]
    return df.withColumns({c: F.when(F.isnan(c), None).otherwise(F.col(c)) for c in targets}) if targets else df


def read_task_table(spark: SparkSession, path: str, schema: T.StructType | None = None,
                    categorical: Sequence[str] = ()) -> DataFrame:
    """Scan a train/test table (parquet, or CSV with header and an explicit schema);
    declared categorical columns present in it are cast to string, NaN -> NULL."""
    if path.endswith(".csv"):
        reader = spark.read.option("header", True)
        df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    else:
        df = spark.read.parquet(path)
    check_columns(df)
    present = [c for c in categorical if c in df.columns]
    if present:
        df = df.withColumns({c: F.col(c).cast("string") for c in present})
    return nan_to_null(df)


def read_pred(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A prediction table by name: parquet if present, else CSV; values as DOUBLE."""
    base = f"{directory.rstrip('/')}/{name}"
    try:
        df = spark.read.parquet(f"{base}.parquet")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        df = spark.read.option("header", True).option("inferSchema", True).csv(f"{base}.csv")
    first = df.columns[0]
    return df.select(first, *[F.col(f"`{c}`").cast("double").alias(c) for c in df.columns[1:]])
