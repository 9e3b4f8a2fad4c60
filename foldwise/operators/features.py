"""Feature builders: DataFrame -> DataFrame functions applied identically to
train, test and source rows; a named builder is looked up in a registry."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUILDERS: dict[str, Callable[..., DataFrame]] = {}


def builder(name: str):
    def deco(fn):
        BUILDERS[name] = fn
        return fn
    return deco


def build_features(df: DataFrame) -> DataFrame:
    """Shared builder (pass-through baseline)."""
    return df


def apply_builders(df: DataFrame, name: str | None = None, **kw) -> DataFrame:
    out = build_features(df)
    if name:
        if name not in BUILDERS:
            raise ValueError(f"unknown feature builder {name!r}; known {sorted(BUILDERS)}")
        out = BUILDERS[name](out, **kw)
    return out


def num_missing(cols: Sequence[str]):
    """Row-wise null count over numeric columns as SMALLINT."""
    total = F.lit(0)
    for c in cols:
        total = total + F.col(c).isNull().cast("int")
    return total.cast("short")


def safe_ratio(a: str, b: str):
    """a / (b + 1e-6) as FLOAT; NULL instead of an error when the divisor is 0."""
    return F.try_divide(F.col(a), F.col(b) + F.lit(1e-6)).cast("float")


@builder("row_example")
def row_example(df: DataFrame, numeric: Sequence[str] = (), ratio: tuple[str, str] | None = None) -> DataFrame:
    """Row-local example features: null count and one safe ratio."""
    out = df.withColumn("num_missing", num_missing(numeric)) if numeric else df
    if ratio:
        out = out.withColumn(f"{ratio[0]}_over_{ratio[1]}", safe_ratio(*ratio))
    return out
