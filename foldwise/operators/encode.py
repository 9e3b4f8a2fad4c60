"""Leak-free smoothed target encoding (nested out-of-fold).

For outer fold k, the train part (fold != k) is split again into
``n_inner`` inner folds; a train row is encoded from the rows of the *other*
inner folds, a validation/test row from the whole train part. Smoothing:
``(sum + prior * s) / (n + s)``, prior = target mean of the whole outer
train part; null or unseen category -> prior.

Rows are never copied per outer fold. A row carries the array of its inner
folds, one place per outer fold; only key, class and hash prefix are ranked
once per outer fold to find them. One aggregate per column holds, for every
category, the target sums of all (outer, inner) cells side by side, and an
encoding adds the other inner folds' sums (no subtraction, so a continuous
target does not cancel). One join per column then gives each row the array
of its encodings: nested ones where it is a train row, the full one of its
own fold where it is a validation row. Hot categories are combined map-side
in the aggregate; the join is an equi-join on the category that AQE
broadcasts when the table is small and splits when a key is skewed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.operators.folds import deal_groups, rank_folds
from foldwise.session import materialize


def null_part(df: DataFrame, c: str, parts: int = 1024) -> Column:
    """0 for a value; for a null, which finds no partner anyway, one of many parts by the row's
    hash, so that the null rows of a join on ``c`` do not meet in one task."""
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.StringType, T.TimestampType, T.DateType))]
    row = F.pmod(F.xxhash64(*[F.col(x) for x in plain]), F.lit(parts))
    return F.when(F.col(c).isNull(), 1 + row).otherwise(F.lit(0)).cast("int")


def _join_cells(rows: DataFrame, cells: DataFrame, c: str, names: Sequence[str]) -> DataFrame:
    """``rows`` with the columns ``names`` of their category's cell (null without one)."""
    w = cells.select(F.col(c).alias("_wc"), F.lit(0).alias("_ws"), *names)
    rows = rows.withColumn("_null_part", null_part(rows, c))
    return rows.join(w, (rows[c] == w["_wc"]) & (rows["_null_part"] == w["_ws"]), "left").drop("_wc", "_ws", "_null_part")


def _number(x: float | None) -> str:
    """A double in SQL."""
    return f"cast({'null' if x is None else repr(repr(x))} as double)"


def _at(array: str | Column, k: Column) -> Column:
    return F.get(array, k)


@dataclass
class TargetEncoding:
    rows: DataFrame             # (id, fold, j, <c>_tes...): arrays over the outer folds; j is null in a row's own fold
    cells: dict[str, DataFrame]  # c -> (c, encs, full, ns): per category, arrays over the outer folds
    priors: DataFrame           # (k, prior)
    cols: list[str]
    n_folds: int
    prior_of: list[float | None]  # by outer fold; null where it is not fitted or has no rows
    folds: list[int] | None = None  # outer folds fitted (None = all)

    @property
    def fitted(self) -> list[int]:
        return list(self.folds) if self.folds is not None else list(range(self.n_folds))

    @property
    def train(self) -> DataFrame:
        """(id, fold, k, j, <c>_te...) of the train rows of every fitted outer fold, k != fold."""
        ks = F.array(*[F.lit(k) for k in self.fitted])
        fold = F.col(self.rows.columns[1])
        long = self.rows.withColumn("k", F.explode(F.filter(ks, lambda k: k != fold)))
        return long.select(*self.rows.columns[:2], "k", _at("j", F.col("k")).alias("j"),
                           *[_at(f"{c}_tes", F.col("k")).alias(f"{c}_te") for c in self.cols])

    @property
    def maps(self) -> dict[str, DataFrame]:
        """c -> (k, c, enc, n): the full train-part encodings of each outer fold."""
        return {c: m.select(F.explode(F.array(*[F.lit(k) for k in self.fitted])).alias("k"), c, "full", "ns").select(
            "k", c, _at("full", F.col("k")).alias("enc"), _at("ns", F.col("k")).alias("n")).where("n > 0") for c, m in self.cells.items()}

    def _priors(self) -> Column:
        return F.array(*[F.lit(p).cast("double") for p in self.prior_of])

    def apply_all(self, rows: DataFrame) -> DataFrame:
        """``rows`` (not of the train part) with ``<c>_tes``: their encodings by each outer fold's map."""
        for c in self.cols:
            rows = _join_cells(rows, self.cells[c], c, ["full"])
            rows = rows.withColumn(f"{c}_tes", F.coalesce("full", self._priors())).drop("full")
        return rows

    def apply(self, df: DataFrame, k_col: str = "k") -> DataFrame:
        """Encode rows that carry an outer fold id ``k_col`` (valid/test/source)."""
        out = self.apply_all(df.where(F.col(k_col).isin(self.fitted)))
        return out.withColumns({f"{c}_te": _at(f"{c}_tes", F.col(k_col)) for c in self.cols}).drop(*[f"{c}_tes" for c in self.cols])

    def valid(self, folded: DataFrame, fold_col: str = "fold") -> DataFrame:
        """Validation rows of each fold, encoded with the map of their own fold."""
        return self.apply(folded.withColumn("k", F.col(fold_col)))

    def test(self, rows: DataFrame) -> DataFrame:
        """Every test row once per outer fold k; its encodings are joined once."""
        wide = self.apply_all(rows).withColumn("k", F.explode(F.array(*[F.lit(k) for k in self.fitted])))
        return wide.withColumns({f"{c}_te": _at(f"{c}_tes", F.col("k")) for c in self.cols}).drop(*[f"{c}_tes" for c in self.cols])


def _inner_folds(base: DataFrame, id_col: str, y_col: str, fold_col: str, ks: Sequence[int], n_folds: int, n_inner: int, seed: int,
                 stratified: bool, group_keys: Sequence[str]) -> DataFrame:
    """``base`` with ``j``: by outer fold the row's inner fold, null in its own fold."""
    others = F.explode(F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: k != F.col(fold_col)))
    places = F.transform(F.sequence(F.lit(0), F.lit(n_folds - 1)), lambda k: F.element_at("_by_k", k))
    collected = F.map_from_entries(F.collect_list(F.struct("k", "j"))).alias("_by_k")  # an entry per outer fold at most
    if group_keys:
        G = list(group_keys)
        # folds of groups need the groups' sizes only; a group counts its rows outside the outer fold
        sizes = base.groupBy(fold_col, *G).agg(F.count(F.lit(1)).alias("_rows")).withColumn("k", others)
        sizes = sizes.groupBy("k", *G).agg(F.sum("_rows").alias("_rows"))
        dealt = deal_groups(sizes, "_rows", n_inner, G, partition_by=["k"], fold_col="j")
        by_group = dealt.groupBy(*G).agg(collected).select(*[F.col(g).alias(f"_g_{g}") for g in G], "_by_k")
        out = base.join(by_group, [base[g].eqNullSafe(by_group[f"_g_{g}"]) for g in G], "left").drop(*[f"_g_{g}" for g in G])
    else:
        L = base.select(id_col, fold_col, *([y_col] if stratified else [])).withColumn("k", others).drop(fold_col)
        L = rank_folds(L, n_inner, seed=seed, id_col=id_col, strata=y_col if stratified else None, partition_by=["k"],
                       salt=[F.col("k")], fold_col="j")
        by_row = L.groupBy(id_col).agg(collected).withColumnRenamed(id_col, "_id")
        out = base.join(by_row, base[id_col] == by_row["_id"], "left").drop("_id")
    own = F.transform(places, lambda j, k: F.when(k != F.col(fold_col), j))
    return out.withColumn("j", own).drop("_by_k")


def fit_target_encoding(
    folded: DataFrame,
    cols: Sequence[str],
    n_folds: int,
    *,
    smoothing: float = 20.0,
    n_inner: int = 5,
    seed: int = 42,
    problem_type: str = "binary",
    group_keys: Sequence[str] = (),
    id_col: str = "id",
    y_col: str = "y",
    fold_col: str = "fold",
    outer_folds: Sequence[int] | None = None,
) -> TargetEncoding:
    """``outer_folds`` restricts the fit to those outer folds (screening runs)."""
    if problem_type == "multiclass":
        raise ValueError("target encoding of a multiclass target is not supported")
    cols, G = list(cols), list(group_keys)
    ks = list(outer_folds) if outer_folds is not None else list(range(n_folds))
    base = materialize(folded.select(*dict.fromkeys([id_col, y_col, fold_col, *cols, *G])))
    # read by the priors, one aggregate per column and the joins: as long as the train part
    rows = materialize(_inner_folds(base, id_col, y_col, fold_col, ks, n_folds, n_inner, seed, problem_type != "regression", G))
    y = F.col(y_col).cast("double")
    sums = {r[fold_col]: (r["s"], r["n"]) for r in rows.groupBy(fold_col).agg(F.sum(y).alias("s"), F.count(y).alias("n")).collect()}
    prior_of: list[float | None] = [None] * n_folds
    for k in ks:
        parts = [v for f, v in sorted(sums.items()) if f != k and v[1]]
        if parts:
            prior_of[k] = sum(s for s, _ in parts) / sum(n for _, n in parts)
    priors = folded.sparkSession.createDataFrame([(k, prior_of[k]) for k in ks if prior_of[k] is not None], "k int, prior double")
    sm = _number(float(smoothing))
    # the cells of fitted outer folds one after the other, each with its inner folds
    at = {k: i * n_inner for i, k in enumerate(ks)}
    inner = f"sequence(0, {n_inner - 1})"

    def total(array: str, zero: str, k: int, without: str) -> str:
        """Sum over the inner folds of outer fold k, in their order."""
        return f"aggregate({inner}, {zero}, (a, x) -> a + if(x = {without}, {zero}, {array}[{at[k]} + x]))"

    def enc(k: int, without: str) -> str:
        p, s, n = _number(prior_of[k]), total("_S", "0D", k, without), total("_N", "0L", k, without)
        return f"if({n} > 0, try_divide({s} + {p} * {sm}, {n} + {sm}), {p})"

    cells: dict[str, DataFrame] = {}
    out = rows
    prior = F.expr(f"array({', '.join(_number(p) for p in prior_of)})")
    for c in cols:
        here = [f"j[{k}] = {i}" for k in ks for i in range(n_inner)]
        cell = rows.where(F.col(c).isNotNull()).groupBy(c).agg(
            *[F.expr(f"coalesce(sum(if({h}, cast(`{y_col}` as double), null)), 0D) AS _s{x}") for x, h in enumerate(here)],
            *[F.expr(f"count_if({h}) AS _n{x}") for x, h in enumerate(here)]).select(
            c, F.array(*[f"_s{x}" for x in range(len(here))]).alias("_S"), F.array(*[f"_n{x}" for x in range(len(here))]).alias("_N"))
        fitted = [k if k in at else None for k in range(n_folds)]
        nested = ", ".join("cast(null as array<double>)" if k is None else f"transform({inner}, i -> {enc(k, 'i')})" for k in fitted)
        full = ", ".join("cast(null as double)" if k is None else enc(k, "-1") for k in fitted)
        counts = ", ".join("0L" if k is None else total("_N", "0L", k, "-1") for k in fitted)
        cells[c] = cell.select(c, F.expr(f"array({nested}) AS encs"), F.expr(f"array({full}) AS full"), F.expr(f"array({counts}) AS ns"))
        out = _join_cells(out, cells[c], c, ["encs", "full"])
        own = F.transform(prior, lambda p, k: F.coalesce(
            F.when(k == F.col(fold_col), _at("full", k)).otherwise(_at(_at("encs", k), _at("j", k))), p))
        out = out.withColumn(f"{c}_tes", own).drop("encs", "full")
    out = out.select(id_col, fold_col, "j", *[f"{c}_tes" for c in cols])
    return TargetEncoding(rows=out, cells=cells, priors=priors, cols=cols, n_folds=n_folds, prior_of=prior_of,
                          folds=list(outer_folds) if outer_folds is not None else None)
