"""Shared category vocabularies (train + test + source) and fixed codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.operators.rank import global_row_number, with_range_chunk
from foldwise.session import materialize


def category_vocab(frames: Sequence[DataFrame | None], cols: Sequence[str]) -> DataFrame:
    """(col, value, code): sorted distinct non-null values per column, codes 0..n-1.

    All columns are unpivoted into one (col, value) table, so one distinct
    and one ranked pass serve every column. The rank is a two-level rank over
    sampled ranges of the values, so a large vocabulary is not ranked in one
    task whatever its values have in common.
    """
    cols = list(cols)
    parts = [f for f in frames if f is not None]
    if not parts or not cols:
        raise ValueError("need at least one frame and one column")
    union = parts[0].select(*cols)
    for f in parts[1:]:
        union = union.unionByName(f.select(*cols))
    pairs = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in cols])
    long = union.select(F.explode(pairs).alias("p")).select("p.*").where(F.col("value").isNotNull()).distinct()
    long = with_range_chunk(materialize(long), [F.col("col"), F.col("value")], "_vb")
    ranked = global_row_number(long, bucket=["_vb"], order=["value"], partition_by=["col"], out="_rn")
    return ranked.select("col", "value", (F.col("_rn") - 1).cast("int").alias("code"))


def category_codes(df: DataFrame, vocab: DataFrame, cols: Sequence[str], suffix: str = "_code") -> DataFrame:
    """Recast to the fixed vocabulary: value -> code; outside the vocabulary or NULL -> NULL."""
    out = df
    for c in cols:
        v = vocab.where(F.col("col") == c).select(F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"{c}{suffix}"))
        out = out.join(v, out[c].cast("string") == v[f"_v_{c}"], "left").drop(f"_v_{c}")
    return out


def augment_train(train_part: DataFrame, source: DataFrame | None, weight: float = 1.0,
                  supports_weight: bool = True, weight_col: str = "w") -> DataFrame:
    """Append source rows to a train part: weight 1 for own rows, ``weight`` for source."""
    if source is None:
        return train_part.withColumn(weight_col, F.lit(1.0))
    if weight != 1.0 and not supports_weight:
        raise ValueError(f"the trainer takes no sample weights; augmentation weight {weight} must be 1.0")
    own = train_part.withColumn(weight_col, F.lit(1.0)).withColumn("is_source", F.lit(False))
    src = source.withColumn(weight_col, F.lit(float(weight))).withColumn("is_source", F.lit(True))
    return own.unionByName(src, allowMissingColumns=True)


def align_source(source: DataFrame, feature_cols: Sequence[str], target_col: str) -> DataFrame:
    """Project an external source to features + target; fail listing all missing columns."""
    required = [*feature_cols, target_col]
    missing = [c for c in required if c not in source.columns]
    if missing:
        raise ValueError(f"source lacks columns {missing}")
    return source.select(*required)
