"""Member prediction tables derived from the task tables (planted signal).

They stand in for trained models when exercising the metric and stacking
operators: every value is a deterministic md5-based number of the row key,
so the same tables can be built in any SQL engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.functions.scalar import uniform

# Fixed definitions of the synthetic members (binary task ``syn``).
BINARY_MEMBERS = {
    "p1": lambda i: 0.5 * uniform(i, "a") + 0.5 * uniform(i, "m1"),
    "p2": lambda i: 0.5 * uniform(i, "a") + 0.5 * uniform(i, "m2"),
    "p3": lambda i: uniform(i, "m3"),
    "p4": lambda i: 0.8 * uniform(i, "a") + 0.2 * uniform(i, "m1"),
}
REGRESSION_SCALE = {"r1": "m1", "r2": "m2"}
MULTICLASS_BOOST = {"c1": 0.6, "c2": 0.4, "c3": 0.0}


def binary_members(task: DataFrame, names=("p1", "p2", "p3"), ties: bool = False) -> DataFrame:
    """Long table (member, id, p). ``ties`` adds ``p1r`` = round(p1, 2)."""
    wide, names = binary_scores(task, names), list(names)
    if ties:
        wide, names = wide.withColumn("p1r", F.round(BINARY_MEMBERS["p1"]("id"), 2)), [*names, "p1r"]
    return long_members(wide, names)


def binary_scores(task: DataFrame, names=("p1", "p2", "p3")) -> DataFrame:
    """``task`` with a column per member."""
    return task.withColumns({n: BINARY_MEMBERS[n]("id") for n in names})


def long_members(wide: DataFrame, names) -> DataFrame:
    """(member, id, p) of a table with a column per member."""
    cols = [F.struct(F.lit(n).alias("member"), F.col(n).alias("p")) for n in names]
    return wide.select("id", F.explode(F.array(*cols)).alias("_m")).select("_m.member", "id", "_m.p")


def regression_members(task: DataFrame) -> DataFrame:
    """(member, id, p): r1, r2 = y * (0.9 + 0.2 u), r3 = y * (0.5 + u)."""
    cols = [F.struct(F.lit(n).alias("member"), (F.col("y") * (0.9 + 0.2 * uniform("id", t))).alias("p"))
            for n, t in REGRESSION_SCALE.items()]
    cols.append(F.struct(F.lit("r3").alias("member"), (F.col("y") * (0.5 + uniform("id", "m3"))).alias("p")))
    return task.select("id", F.explode(F.array(*cols)).alias("_m")).select("_m.member", "id", "_m.p")


def multiclass_members(task_coded: DataFrame, n_classes: int) -> DataFrame:
    """(member, id, probs ARRAY<DOUBLE>): md5 noise + boost on the true class, normalised."""
    def raw_prob(k: int, tag: str, boost: float):
        key = F.concat(F.col("id").cast("string"), F.lit(f":{k}"))
        return uniform(key, tag) + F.when(F.col("code") == k, F.lit(boost)).otherwise(F.lit(0.0))

    out = []
    for name, boost in MULTICLASS_BOOST.items():
        raw = F.array(*[raw_prob(k, name, boost) for k in range(n_classes)])
        out.append(F.struct(F.lit(name).alias("member"), raw.alias("raw")))
    m = task_coded.select("id", F.explode(F.array(*out)).alias("_m")).select("_m.member", "id", "_m.raw")
    s = F.aggregate("raw", F.lit(0.0), lambda a, x: a + x)
    return m.select("member", "id", F.transform("raw", lambda x: x / s).alias("probs"))
