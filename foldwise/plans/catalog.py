"""Registered queries: one Spark job per operator plus its DuckDB oracle.

Every query reads the driver tables (or tables Spark derives from them), so
its work grows with them. Doubles are rounded to 6 digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.plans import sqlkit as S
from foldwise.sources import tasks as T
from foldwise.operators import folds as FO
from foldwise.plans import oof as OOF
from foldwise.functions.scalar import uniform
from foldwise.session import materialize, with_scalars
from foldwise.sources.files import read_pred, read_task_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _folded(spark, sf, task="bin", n=5):
    t, spec = T.load_task(spark, sf, task)
    return FO.assign_folds(T.train_rows(t), spec, n_folds=n), spec, t


# ---------------------------------------------------------------- sources
@query("scan_task", """SELECT event_id AS id, CAST(user_id AS VARCHAR) AS user_id, event_type,
  round(CASE WHEN isnan(value) THEN NULL ELSE value END, 6) AS value FROM events""")
def q_scan_task(spark, sf):
    """The file scan itself: declared categories as text, NaN as null."""
    t = read_task_table(spark, f"{sf}/events.parquet", categorical=["user_id", "event_type", "not_there"])
    return t.select(F.col("event_id").alias("id"), "user_id", "event_type", r6("value").alias("value"))


# ---------------------------------------------------------------- folds
@query("stratified_folds", f"""WITH {S.folded('bin')}
SELECT id, y, fold FROM f""")
def q_stratified_folds(spark, sf):
    f, _, _ = _folded(spark, sf, "bin")
    return f.select("id", "y", "fold")


@query("kfold", f"""WITH {S.folded('reg', strategy='KFold')}
SELECT id, fold FROM f""")
def q_kfold(spark, sf):
    f, _, _ = _folded(spark, sf, "reg")
    return f.select("id", "fold")


# Two group columns, one of them with nulls: rows of one pair of values share a fold.
_PAIR_TASK = f"""t AS (SELECT *, CASE WHEN {S.U('id', 'gap')} >= 0.2 THEN user_id END AS user, hour(ts) AS hour FROM ({S.TASKS['bin']})),
tr AS (SELECT * FROM t WHERE part = 'train'),
gs AS (SELECT "user", hour, count(*) AS gn FROM tr GROUP BY "user", hour),
gr AS (SELECT "user", hour, CAST((row_number() OVER (ORDER BY gn DESC, md5(coalesce(CAST("user" AS VARCHAR), '') || '|' || CAST(hour AS VARCHAR)),
        "user" NULLS FIRST, hour NULLS FIRST) - 1) % 5 AS INTEGER) AS fold FROM gs)"""


@query("group_folds_two_keys", f"""WITH {_PAIR_TASK.replace(' AS user,', ' AS "user",')}
SELECT tr.id, gr.fold FROM tr JOIN gr ON tr."user" IS NOT DISTINCT FROM gr."user" AND tr.hour = gr.hour""")
def q_group_folds_two_keys(spark, sf):
    t, spec = T.load_task(spark, sf, "bin")
    tr = T.train_rows(t).withColumns({"user": F.when(uniform("id", "gap") >= 0.2, F.col("user_id")), "hour": F.hour("ts")})
    return FO.group_folds(tr, 5, ["user", "hour"]).select("id", "fold")


@query("group_folds", f"""WITH {S.folded('grp', strategy='GroupKFold')}
SELECT id, user_id, fold FROM f""")
def q_group_folds(spark, sf):
    f, _, _ = _folded(spark, sf, "grp")
    return f.select("id", "user_id", "fold")


# ---------------------------------------------------------------- target encoding
from foldwise.operators.encode import fit_target_encoding  # noqa: E402


def _te(spark, sf, task="bin", col="user_id", inner_groups=False):
    t, spec = T.load_task(spark, sf, task)
    tr = T.train_rows(t)
    if task == "grp":
        tr = tr.withColumn("hour", F.hour("ts"))
    f = FO.assign_folds(tr, spec)
    enc = fit_target_encoding(
        f, [col], spec.n_folds, smoothing=spec.te_smoothing, seed=spec.seed, problem_type=spec.problem_type,
        group_keys=spec.group_keys if inner_groups else (),
    )
    return enc, f, t


@query("te_oof_train", f"""WITH {S.te_ctes('bin', 'user_id', 'StratifiedKFold', 'strat')}
SELECT id, k, round(te, 6) AS user_id_te FROM te""")
def q_te_oof_train(spark, sf):
    enc, _, _ = _te(spark, sf)
    return enc.train.select("id", "k", r6("user_id_te").alias("user_id_te"))


@query("te_map", f"""WITH {S.te_ctes('bin', 'user_id', 'StratifiedKFold', 'strat')}
SELECT map.k, map.user_id, round(map.enc, 6) AS enc, CAST(map.n AS BIGINT) AS n, round(pr.prior, 6) AS prior
FROM map JOIN pr ON map.k = pr.k""")
def q_te_map(spark, sf):
    enc, _, _ = _te(spark, sf)
    m = enc.maps["user_id"].join(enc.priors, "k")
    return m.select("k", "user_id", r6("enc").alias("enc"), "n", r6("prior").alias("prior"))


@query("te_valid", f"""WITH {S.te_ctes('bin', 'user_id', 'StratifiedKFold', 'strat')}
SELECT f.id, f.fold AS k, round(coalesce(map.enc, pr.prior), 6) AS user_id_te
FROM f JOIN pr ON pr.k = f.fold LEFT JOIN map ON map.k = f.fold AND map.user_id = f.user_id""")
def q_te_valid(spark, sf):
    enc, f, _ = _te(spark, sf)
    return enc.valid(f).select("id", "k", r6("user_id_te").alias("user_id_te"))


@query("te_apply_test", f"""WITH {S.te_ctes('bin', 'user_id', 'StratifiedKFold', 'strat')}
SELECT t.id, pr.k, round(coalesce(map.enc, pr.prior), 6) AS user_id_te
FROM t CROSS JOIN pr LEFT JOIN map ON map.k = pr.k AND map.user_id = t.user_id WHERE t.part = 'test'""")
def q_te_apply_test(spark, sf):
    enc, _, t = _te(spark, sf)
    return enc.test(T.test_rows(t)).select("id", "k", r6("user_id_te").alias("user_id_te"))


@query("te_group_aware", f"""WITH {S.te_ctes('grp', 'hour', 'GroupKFold', 'group').replace(
    "t AS (" + S.TASKS['grp'] + ")", "t AS (SELECT *, hour(ts) AS hour FROM (" + S.TASKS['grp'] + "))")}
SELECT id, k, round(te, 6) AS hour_te FROM te""")
def q_te_group_aware(spark, sf):
    enc, _, _ = _te(spark, sf, "grp", "hour", inner_groups=True)
    return enc.train.select("id", "k", r6("hour_te").alias("hour_te"))


@query("te_regression", f"""WITH {S.te_ctes('reg', 'o_custkey', 'KFold', 'plain')}
SELECT id, k, round(te, 6) AS o_custkey_te FROM te""")
def q_te_regression(spark, sf):
    enc, _, _ = _te(spark, sf, "reg", "o_custkey")
    return enc.train.select("id", "k", r6("o_custkey_te").alias("o_custkey_te"))


# ---------------------------------------------------------------- metrics
from foldwise.operators import metrics as M  # noqa: E402
from foldwise.operators.labels import fit_label_map  # noqa: E402
from foldwise.sources import members as MB  # noqa: E402

EPS = 2.220446049250313e-16


def _syn_oof(spark, sf, ties=True, names=("p1", "p2", "p3")):
    """(member, id, fold, y, p) over the train rows of the planted-signal task."""
    f, spec, t = _folded(spark, sf, "syn")
    m = MB.binary_members(f, names=names, ties=ties)
    return m.join(f.select("id", "fold", "y"), "id"), f, t


def _reg_oof(spark, sf):
    f, spec, t = _folded(spark, sf, "reg")
    m = MB.regression_members(f)
    return m.join(f.select("id", "fold", "y"), "id"), f


def _mc_oof(spark, sf):
    t, spec = T.load_task(spark, sf, "mc")
    lm = fit_label_map(spark, T.train_rows(t))
    tc = lm.encode(t)
    f = FO.assign_folds(T.train_rows(tc), spec)
    mm = MB.multiclass_members(tc, lm.n_classes)
    return mm.join(f.select("id", "fold", "code"), "id"), lm, tc, f


SYN_OOF = f"""{S.folded('syn')},
m AS ({S.bin_members('f', ties=True)}),
mo AS (SELECT m.member, m.id, f.fold, f.y, m.p FROM m JOIN f ON m.id = f.id)"""
REG_OOF = f"""{S.folded('reg', strategy='KFold')},
m AS ({S.reg_members('f')}),
mo AS (SELECT m.member, m.id, f.fold, f.y, m.p FROM m JOIN f ON m.id = f.id)"""
MC_OOF = f"""{S.mc_ctes()},
f AS (SELECT *, {S.strat_fold(5, 42, 'code')} AS fold FROM tc WHERE part = 'train'),
mo AS (SELECT mm.member, mm.id, f.fold, f.code, mm.probs FROM mm JOIN f ON mm.id = f.id)"""


@query("auc_by_fold", f"""WITH {SYN_OOF}
SELECT member, CAST(fold AS INTEGER) AS fold, round(auc, 6) AS auc FROM {S.auc_sql('mo', 'member, fold')}""")
def q_auc_by_fold(spark, sf):
    mo, _, _ = _syn_oof(spark, sf)
    return M.auc(mo, ["member", "fold"]).select("member", "fold", r6("auc").alias("auc"))


@query("oof_score", f"""WITH {SYN_OOF}
SELECT member, round(auc, 6) AS auc FROM {S.auc_sql('mo', 'member')}""")
def q_oof_score(spark, sf):
    mo, _, _ = _syn_oof(spark, sf)
    return M.auc(mo, ["member"]).select("member", r6("auc").alias("auc"))


@query("cv_summary", f"""WITH {SYN_OOF}, fs AS (SELECT * FROM {S.auc_sql('mo', 'member, fold')})
SELECT member, round(avg(auc), 6) AS cv_mean, round(stddev_pop(auc), 6) AS cv_std, count(*) AS n_folds
FROM fs GROUP BY member""")
def q_cv_summary(spark, sf):
    mo, _, _ = _syn_oof(spark, sf)
    return M.cv_summary(M.auc(mo, ["member", "fold"], out="score"), ["member"])


@query("logloss_by_fold", f"""WITH {SYN_OOF}
SELECT member, fold, round(avg(-(y * ln(least(greatest(p, {EPS}), 1 - {EPS}))
  + (1 - y) * ln(1 - least(greatest(p, {EPS}), 1 - {EPS})))), 6) AS logloss FROM mo GROUP BY member, fold""")
def q_logloss_by_fold(spark, sf):
    mo, _, _ = _syn_oof(spark, sf)
    return M.logloss(mo, ["member", "fold"]).select("member", "fold", r6("logloss").alias("logloss"))


@query("accuracy_by_fold", f"""WITH {SYN_OOF}
SELECT member, fold, round(avg(CAST(CAST(p > 0.5 AS INTEGER) = y AS DOUBLE)), 6) AS accuracy
FROM mo GROUP BY member, fold""")
def q_accuracy_by_fold(spark, sf):
    mo, _, _ = _syn_oof(spark, sf)
    return M.accuracy(mo, ["member", "fold"]).select("member", "fold", r6("accuracy").alias("accuracy"))


@query("rmse_by_fold", f"""WITH {REG_OOF}
SELECT member, fold, round(sqrt(avg(pow(y - p, 2))), 6) AS rmse FROM mo GROUP BY member, fold""")
def q_rmse_by_fold(spark, sf):
    mo, _ = _reg_oof(spark, sf)
    return M.rmse(mo, ["member", "fold"]).select("member", "fold", r6("rmse").alias("rmse"))


@query("mae_by_fold", f"""WITH {REG_OOF}
SELECT member, fold, round(avg(abs(y - p)), 6) AS mae FROM mo GROUP BY member, fold""")
def q_mae_by_fold(spark, sf):
    mo, _ = _reg_oof(spark, sf)
    return M.mae(mo, ["member", "fold"]).select("member", "fold", r6("mae").alias("mae"))


@query("mc_logloss", f"""WITH {MC_OOF},
c AS (SELECT member, fold, code, list_transform(probs, lambda x: least(greatest(x, {EPS}), 1 - {EPS})) AS cp FROM mo)
SELECT member, fold, round(avg(-ln(list_extract(cp, code + 1) / list_sum(cp))), 6) AS logloss FROM c GROUP BY member, fold""")
def q_mc_logloss(spark, sf):
    mo, _, _, _ = _mc_oof(spark, sf)
    return M.mc_logloss(mo, ["member", "fold"]).select("member", "fold", r6("logloss").alias("logloss"))


@query("balanced_accuracy", f"""WITH {MC_OOF},
h AS (SELECT member, fold, code, CAST(list_position(probs, list_max(probs)) - 1 = code AS DOUBLE) AS hit FROM mo),
rc AS (SELECT member, fold, code, avg(hit) AS rec FROM h GROUP BY member, fold, code)
SELECT member, fold, round(avg(rec), 6) AS balanced_accuracy FROM rc GROUP BY member, fold""")
def q_balanced_accuracy(spark, sf):
    mo, _, _, _ = _mc_oof(spark, sf)
    return M.balanced_accuracy(mo, ["member", "fold"], y="code", p="probs").select(
        "member", "fold", r6("balanced_accuracy").alias("balanced_accuracy"))


@query("mc_accuracy_by_fold", f"""WITH {MC_OOF}
SELECT member, fold, round(avg(CAST(list_position(probs, list_max(probs)) - 1 = code AS DOUBLE)), 6) AS accuracy
FROM mo GROUP BY member, fold""")
def q_mc_accuracy_by_fold(spark, sf):
    mo, _, _, _ = _mc_oof(spark, sf)
    return M.accuracy(mo, ["member", "fold"], y="code", p="probs", multiclass=True).select(
        "member", "fold", r6("accuracy").alias("accuracy"))


# ---------------------------------------------------------------- minimum slice
from foldwise.plans.slice import minimum_slice  # noqa: E402


@query("slice_auc", f"""WITH {S.te_ctes('bin', 'user_id', 'StratifiedKFold', 'strat')},
oof AS (SELECT f.id, f.fold, f.y, coalesce(map.enc, pr.prior) AS p
        FROM f JOIN pr ON pr.k = f.fold LEFT JOIN map ON map.k = f.fold AND map.user_id = f.user_id),
fs AS (SELECT * FROM {S.auc_sql('oof', 'fold')})
SELECT round(avg(auc), 6) AS cv_mean, round(stddev_pop(auc), 6) AS cv_std, count(*) AS n_folds FROM fs""")
def q_slice_auc(spark, sf):
    _, fold_auc = minimum_slice(spark, sf)
    return M.cv_summary(fold_auc)


# ---------------------------------------------------------------- past-only windows
from foldwise.operators.history import fill_past, past_features  # noqa: E402

_W_EV = "PARTITION BY user_id ORDER BY ts NULLS LAST, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def _past(spark, sf, agg):
    t = T.bin_task(spark, sf)
    out = past_features(t, "value", ["user_id"], "ts", aggs=[agg], exact_scale=6)
    return out.select("id", r6(f"value_past_{agg}").alias(f"value_past_{agg}"))


def _past_sql(fn, agg):
    return f"""WITH t AS ({S.TASKS['bin']})
SELECT id, round({fn}(value) OVER ({_W_EV}), 6) AS value_past_{agg} FROM t"""


_EXACT = {
    "mean": f"CAST(sum(CAST(value AS DECIMAL(38,6))) OVER ({_W_EV}) AS DOUBLE) / count(value) OVER ({_W_EV})",
    "sum": f"CAST(sum(CAST(value AS DECIMAL(38,6))) OVER ({_W_EV}) AS DOUBLE)",
}
for _agg, _fn in [("mean", "avg"), ("std", "stddev_samp"), ("max", "max"), ("min", "min"), ("sum", "sum")]:
    _sql = _past_sql(_fn, _agg)
    if _agg in _EXACT:
        _sql = f"""WITH t AS ({S.TASKS['bin']})
SELECT id, round({_EXACT[_agg]}, 6) AS value_past_{_agg} FROM t"""
    query(f"past_{_agg}", _sql)(lambda spark, sf, a=_agg: _past(spark, sf, a))

@query("past_fill", f"""WITH t AS ({S.TASKS['bin']})
SELECT id, round(CAST(CAST(coalesce({_EXACT['mean']}, -1.0) AS FLOAT) AS DOUBLE), 4) AS value_past_mean FROM t""")
def q_past_fill(spark, sf):
    """Past features as a model takes them: a default where there is no past, single precision."""
    out = past_features(T.bin_task(spark, sf), "value", ["user_id"], "ts", aggs=["mean"], exact_scale=6)
    out = fill_past(out, ["value_past_mean"], default=-1.0)
    return out.select("id", F.round(F.col("value_past_mean").cast("double"), 4).alias("value_past_mean"))


_W_ORD = "PARTITION BY o_custkey ORDER BY o_orderdate NULLS LAST, id"


@query("group_lag", f"""WITH t AS ({S.TASKS['reg']})
SELECT id, round(lag(y, 1) OVER ({_W_ORD}), 6) AS y_lag1, round(lag(y, 3) OVER ({_W_ORD}), 6) AS y_lag3 FROM t""")
def q_group_lag(spark, sf):
    t = T.reg_task(spark, sf)
    out = past_features(t, "y", ["o_custkey"], "o_orderdate", aggs=[], lags=[1, 3])
    return out.select("id", r6("y_lag1").alias("y_lag1"), r6("y_lag3").alias("y_lag3"))


@query("group_cumcount", f"""WITH t AS ({S.TASKS['reg']})
SELECT id, row_number() OVER ({_W_ORD}) - 1 AS cumcount,
  round(avg(y) OVER ({_W_ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS y_past_mean FROM t""")
def q_group_cumcount(spark, sf):
    t = T.reg_task(spark, sf)
    out = past_features(t, "y", ["o_custkey"], "o_orderdate", aggs=["mean"], cumcount=True)
    return out.select("id", "cumcount", r6("y_past_mean").alias("y_past_mean"))


# ---------------------------------------------------------------- profile / schema / vocab
from foldwise.functions import scalar as X  # noqa: E402
from foldwise.operators import blend as BL  # noqa: E402
from foldwise.operators import profile as PR  # noqa: E402
from foldwise.operators import vocab as VO  # noqa: E402
from foldwise.operators.features import apply_builders  # noqa: E402


@query("cat_target_rate", f"""WITH t AS ({S.TASKS['imb']})
SELECT lang, round(avg(CAST(y AS DOUBLE)), 6) AS rate, count(*) AS n,
  round((SELECT avg(CAST(y AS DOUBLE)) FROM t), 6) AS overall FROM t WHERE lang IS NOT NULL GROUP BY lang""")
def q_cat_target_rate(spark, sf):
    r = PR.cat_target_rate(T.imb_task(spark, sf), "lang")
    return r.select("lang", r6("rate").alias("rate"), "n", r6("overall").alias("overall"))


@query("num_hist_by_class", f"""WITH t AS ({S.TASKS['bin']}),
rg AS (SELECT min(value) AS lo, max(value) AS hi FROM t),
b AS (SELECT t.y, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((value - lo) / (hi - lo) * 50), 49) END AS INTEGER) AS bin,
        lo, CASE WHEN hi = lo THEN 1.0 ELSE (hi - lo) / 50 END AS w FROM t, rg WHERE value IS NOT NULL),
c AS (SELECT y, bin, lo, w, count(*) AS cnt FROM b GROUP BY y, bin, lo, w),
cn AS (SELECT y, count(*) AS n FROM t WHERE value IS NOT NULL GROUP BY y)
SELECT c.y, c.bin, round(lo + bin * w, 6) AS lo, cnt AS count, round(cnt / (n * w), 6) AS density FROM c JOIN cn ON c.y = cn.y""")
def q_num_hist_by_class(spark, sf):
    h = PR.num_hist_by_class(T.bin_task(spark, sf), "value", "y", bins=50)
    return h.select("y", "bin", r6("lo").alias("lo"), "count", r6("density").alias("density"))


def _profile_sql():
    cols = [("id", "bigint"), ("y", "int"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"),
            ("part", "string")]
    sel = []
    for c, ty in cols:
        sel.append(f"""SELECT '{c}' AS feature, '{ty}' AS dtype, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS n_null,
  CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct,
  (SELECT CAST({c} AS VARCHAR) FROM t ORDER BY id LIMIT 1) AS first_value,
  (SELECT CAST({c} AS VARCHAR) FROM t ORDER BY id LIMIT 1 OFFSET 1) AS second_value FROM t""")
    return f"WITH t AS ({S.TASKS['imb']})\n" + "\nUNION ALL\n".join(sel)


@query("profile", _profile_sql())
def q_profile(spark, sf):
    return PR.profile(T.imb_task(spark, sf))


@query("category_vocab", f"""WITH t AS ({S.TASKS['imb']}),
u AS (SELECT 'lang' AS col, lang AS value FROM t UNION SELECT 'source' AS col, source AS value FROM t)
SELECT col, value, CAST(row_number() OVER (PARTITION BY col ORDER BY value) - 1 AS INTEGER) AS code
FROM u WHERE value IS NOT NULL""")
def q_category_vocab(spark, sf):
    t = T.imb_task(spark, sf)
    return VO.category_vocab([T.train_rows(t), T.test_rows(t), t.where("part = 'source'")], ["lang", "source"])


@query("category_codes", f"""WITH t AS ({S.TASKS['imb']}),
u AS (SELECT DISTINCT source AS value FROM t WHERE part IN ('train', 'source') AND source IS NOT NULL),
v AS (SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS code FROM u)
SELECT t.id, v.code AS source_code FROM t LEFT JOIN v ON t.source = v.value""")
def q_category_codes(spark, sf):
    t = T.imb_task(spark, sf)
    vocab = VO.category_vocab([T.train_rows(t), t.where("part = 'source'")], ["source"])
    return VO.category_codes(t, vocab, ["source"]).select("id", "source_code")


@query("augment_train", f"""WITH {S.folded('bin')},
s AS (SELECT y, user_id, value FROM t WHERE part = 'source'),
k AS (SELECT CAST(range AS INTEGER) AS k FROM range(5))
SELECT k.k, f.id, f.y, CAST(1.0 AS DOUBLE) AS w FROM f JOIN k ON f.fold <> k.k
UNION ALL SELECT k.k, NULL AS id, s.y, CAST(0.5 AS DOUBLE) AS w FROM s CROSS JOIN k""")
def q_augment_train(spark, sf):
    f, spec, t = _folded(spark, sf, "bin")
    src = VO.align_source(T.source_rows(t), ["user_id", "value"], "y")
    ks = F.sequence(F.lit(0), F.lit(spec.n_folds - 1))
    trk = f.withColumn("k", F.explode(F.filter(ks, lambda k: k != F.col("fold"))))   # train part of every fold
    srk = src.withColumn("k", F.explode(ks))                                           # source rows join each
    aug = VO.augment_train(trk.select("k", "id", "y", "user_id", "value"), srk, weight=0.5)
    return aug.select("k", "id", "y", "w")


@query("source_align", f"""WITH t AS ({S.TASKS['bin']})
SELECT y, user_id, round(value, 6) AS value FROM t WHERE part = 'source'""")
def q_source_align(spark, sf):
    t = T.bin_task(spark, sf)
    s = VO.align_source(T.source_rows(t), ["user_id", "value"], "y")
    return s.select("y", "user_id", r6("value").alias("value"))


@query("feature_cols", f"""WITH t AS ({S.TASKS['bin']})
SELECT user_id, round(value, 6) AS value FROM t WHERE part = 'train'""")
def q_feature_cols(spark, sf):
    t, spec = T.load_task(spark, sf, "bin")
    tr = T.train_rows(t).drop("ts")
    feats = spec.feature_cols(tr.columns)
    return tr.select(*feats).withColumn("value", r6("value"))


@query("feature_builder", f"""WITH t AS ({S.TASKS['bin']})
SELECT id, CAST(CAST(value IS NULL AS INTEGER) + CAST(user_id IS NULL AS INTEGER) AS SMALLINT) AS num_missing,
  round(CAST(CAST(value / (user_id + 1e-6) AS FLOAT) AS DOUBLE), 6) AS value_over_user_id FROM t""")
def q_feature_builder(spark, sf):
    t = T.bin_task(spark, sf)
    b = apply_builders(t, "row_example", numeric=["value", "user_id"], ratio=("value", "user_id"))
    return b.select("id", "num_missing", r6(F.col("value_over_user_id").cast("double")).alias("value_over_user_id"))


@query("num_missing", f"""WITH t AS ({S.TASKS['imb']})
SELECT id, CAST(CAST(n_chars IS NULL AS INTEGER) + CAST(y IS NULL AS INTEGER) AS SMALLINT) AS num_missing FROM t""")
def q_num_missing(spark, sf):
    from foldwise.operators.features import num_missing
    return T.imb_task(spark, sf).select("id", num_missing(["n_chars", "y"]).alias("num_missing"))


@query("safe_ratio", f"""WITH t AS ({S.TASKS['imb']})
SELECT id, round(CAST(CAST(n_chars / (CAST(y AS DOUBLE) + 1e-6) AS FLOAT) AS DOUBLE), 6) AS n_chars_over_y FROM t""")
def q_safe_ratio(spark, sf):
    from foldwise.operators.features import safe_ratio
    t = T.imb_task(spark, sf)
    return t.select("id", r6(safe_ratio("n_chars", "y").cast("double")).alias("n_chars_over_y"))


@query("label_encode", f"""WITH {S.mc_ctes()}
SELECT id, code FROM tc""")
def q_label_encode(spark, sf):
    t = T.mc_task(spark, sf)
    lm = fit_label_map(spark, T.train_rows(t))
    return lm.encode(t).select("id", "code")


@query("label_decode", f"""WITH {S.mc_ctes()}
SELECT tc.id, lm.label FROM tc JOIN lm ON tc.code = lm.code""")
def q_label_decode(spark, sf):
    t = T.mc_task(spark, sf)
    lm = fit_label_map(spark, T.train_rows(t))
    coded = lm.encode(t).select("id", "code")
    return lm.decode(coded, "code", "label").select("id", "label")


@query("argmax_label", f"""WITH {S.mc_ctes()}
SELECT mm.member, mm.id, lm.label AS label FROM mm JOIN lm ON list_position(mm.probs, list_max(mm.probs)) - 1 = lm.code""")
def q_argmax_label(spark, sf):
    _, lm, tc, _ = _mc_oof(spark, sf)
    mm = MB.multiclass_members(tc, lm.n_classes).withColumn("pred_code", X.argmax_code("probs"))
    return lm.decode(mm, "pred_code", "label").select("member", "id", "label")


@query("fold_slice", f"""WITH {S.folded('bin')}, k AS (SELECT CAST(range AS INTEGER) AS k FROM range(5))
SELECT k.k, count(*) FILTER (WHERE f.fold <> k.k) AS n_train, count(*) FILTER (WHERE f.fold = k.k) AS n_valid,
  round(avg(CAST(f.y AS DOUBLE)) FILTER (WHERE f.fold <> k.k), 6) AS train_rate
FROM k CROSS JOIN f GROUP BY k.k""")
def q_fold_slice(spark, sf):
    f, spec, _ = _folded(spark, sf, "bin")
    out = None
    for k in range(spec.n_folds):
        train, valid = FO.fold_slice(f, k)
        r = with_scalars(train.agg(F.lit(k).alias("k"), F.count(F.lit(1)).alias("n_train"), r6(F.avg("y")).alias("train_rate")),
                         valid.agg(F.count(F.lit(1)).alias("n_valid")))
        out = r if out is None else out.unionByName(r)
    return out.select("k", "n_train", "n_valid", "train_rate")


@query("screening_folds", f"""WITH {S.folded('bin')}
SELECT id, fold FROM f WHERE fold < 2""")
def q_screening_folds(spark, sf):
    f, _, _ = _folded(spark, sf, "bin")
    return FO.screening_folds(f, 2).select("id", "fold")


@query("logit", f"""WITH {S.folded('syn')}, m AS ({S.bin_members('f')})
SELECT member, id, round(ln(least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6))), 6) AS z FROM m""")
def q_logit(spark, sf):
    f, _, _ = _folded(spark, sf, "syn")
    m = MB.binary_members(f)
    return m.select("member", "id", r6(X.logit("p")).alias("z"))


@query("rank_mean", f"""WITH {S.folded('syn')}, m AS ({S.bin_members('f')}),
mo AS (SELECT m.member, m.id, f.fold, m.p FROM m JOIN f ON m.id = f.id),
r AS (SELECT member, id, fold, (rank() OVER (PARTITION BY fold, member ORDER BY p) - 1
        + (count(*) OVER (PARTITION BY fold, member, p) + 1) / 2.0) / count(*) OVER (PARTITION BY fold, member) AS rr FROM mo)
SELECT id, round(round(avg(rr), 12), 6) AS oof FROM r GROUP BY id""")
def q_rank_mean(spark, sf):
    mo, _, _ = _syn_oof(spark, sf, ties=False)
    return BL.rank_mean(mo, ["fold"]).select("id", r6("p").alias("oof"))


# ---------------------------------------------------------------- members / simple blends
from foldwise.operators import members as MM  # noqa: E402
import numpy as np  # noqa: E402

MEMBERS3 = ["p1", "p2", "p3"]


@query("member_matrix", f"""WITH {SYN_OOF}
SELECT id, round(max(p) FILTER (WHERE member = 'p1'), 6) AS p1, round(max(p) FILTER (WHERE member = 'p2'), 6) AS p2,
  round(max(p) FILTER (WHERE member = 'p3'), 6) AS p3 FROM mo WHERE member <> 'p1r' GROUP BY id""")
def q_member_matrix(spark, sf):
    mo, _, _ = _syn_oof(spark, sf, ties=False)
    mx = MM.member_matrix(mo, MEMBERS3)
    return mx.select("id", *[r6(m).alias(m) for m in MEMBERS3])


def _misaligned(f, t):
    """p1 clean; p2 with ~1% ids twice; p3 without ~1% ids and with ~1% test ids."""
    m = MB.binary_members(f)
    dup = m.where((F.col("member") == "p2") & (uniform("id", "dup") < 0.01))
    p3 = m.where((F.col("member") != "p3") | (uniform("id", "miss") >= 0.01))
    extra = MB.binary_members(T.test_rows(t), names=("p3",)).where(uniform("id", "extra") < 0.01)
    return p3.unionByName(dup).unionByName(extra)


@query("id_align_check", f"""WITH {S.folded('syn')}, m0 AS ({S.bin_members('f')}),
m AS (SELECT * FROM m0 WHERE member <> 'p3' OR {S.U('id', 'miss')} >= 0.01
      UNION ALL SELECT * FROM m0 WHERE member = 'p2' AND {S.U('id', 'dup')} < 0.01
      UNION ALL SELECT 'p3' AS member, id, {S.BIN_MEMBERS['p3']} AS p FROM t WHERE part = 'test' AND {S.U('id', 'extra')} < 0.01),
pi AS (SELECT member, id, count(*) AS c FROM m GROUP BY member, id),
ml AS (SELECT * FROM (VALUES ('p1'), ('p2'), ('p3')) v(member))
SELECT ml.member,
  CAST(coalesce((SELECT sum(c) FROM pi WHERE pi.member = ml.member), 0) AS BIGINT) AS n_rows,
  CAST((SELECT count(*) FROM pi WHERE pi.member = ml.member AND c > 1) AS BIGINT) AS n_dup_ids,
  CAST((SELECT count(*) FROM f WHERE NOT EXISTS (SELECT 1 FROM pi WHERE pi.member = ml.member AND pi.id = f.id)) AS BIGINT) AS n_missing,
  CAST((SELECT count(*) FROM pi WHERE pi.member = ml.member AND NOT EXISTS (SELECT 1 FROM f WHERE f.id = pi.id)) AS BIGINT) AS n_extra
FROM ml""")
def q_id_align_check(spark, sf):
    f, _, t = _folded(spark, sf, "syn")
    return MM.alignment_report(_misaligned(f, t), f.select("id"), MEMBERS3)


def _corr_sql(members, src="w"):
    rows = []
    for a in members:
        for b in members:
            v = ("CASE WHEN stddev_pop({a}) > 0 THEN 1.0 END".format(a=a) if a == b else
                 f"CASE WHEN stddev_pop({a}) * stddev_pop({b}) > 0 THEN covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END")
            rows.append(f"SELECT '{a}' AS member_a, '{b}' AS member_b, round({v}, 4) AS corr FROM {src}")
    return " UNION ALL ".join(rows)


@query("oof_corr", f"""WITH {SYN_OOF},
w AS (SELECT id, max(p) FILTER (WHERE member = 'p1') AS p1, max(p) FILTER (WHERE member = 'p2') AS p2,
  max(p) FILTER (WHERE member = 'p3') AS p3, 0.5 AS p5 FROM mo GROUP BY id)
{_corr_sql(['p1', 'p2', 'p3', 'p5'])}""")
def q_oof_corr(spark, sf):
    mo, _, _ = _syn_oof(spark, sf, ties=False)
    mx = MM.member_matrix(mo, MEMBERS3).withColumn("p5", F.lit(0.5))
    return MM.correlation(mx, MEMBERS3 + ["p5"])


@query("member_scores", f"""WITH {SYN_OOF}, a AS (SELECT * FROM {S.auc_sql('mo', 'member')})
SELECT a.member, round(a.auc, 6) AS auc, round(l.logloss, 6) AS logloss FROM a JOIN
 (SELECT member, avg(-(y * ln(least(greatest(p, {EPS}), 1 - {EPS})) + (1 - y) * ln(1 - least(greatest(p, {EPS}), 1 - {EPS})))) AS logloss
  FROM mo GROUP BY member) l ON a.member = l.member""")
def q_member_scores(spark, sf):
    mo, _, _ = _syn_oof(spark, sf)
    s = M.auc(mo, ["member"]).join(M.logloss(mo, ["member"]), "member")
    return s.select("member", r6("auc").alias("auc"), r6("logloss").alias("logloss"))


@query("blend_equal", f"""WITH {SYN_OOF}
SELECT id, round(avg(p), 6) AS oof FROM mo WHERE member <> 'p1r' GROUP BY id""")
def q_blend_equal(spark, sf):
    mo, _, _ = _syn_oof(spark, sf, ties=False)
    return BL.blend_equal(mo, out="oof").select("id", r6("oof").alias("oof"))


@query("mc_blend_equal", f"""WITH {MC_OOF},
e AS (SELECT mo.id, u.k, u.v FROM mo, unnest(mo.probs) WITH ORDINALITY AS u(v, k)),
a AS (SELECT id, k, avg(v) AS a FROM e GROUP BY id, k)
SELECT id, CAST(k - 1 AS INTEGER) AS code, round(a / sum(a) OVER (PARTITION BY id), 6) AS p FROM a""")
def q_mc_blend_equal(spark, sf):
    mo, lm, _, _ = _mc_oof(spark, sf)
    b = BL.mc_blend_equal(mo, lm.n_classes)
    return b.select("id", F.posexplode("probs").alias("code", "p")).select("id", "code", r6("p").alias("p"))


@query("test_pred_mean", f"""WITH t AS ({S.TASKS['syn']}), k AS (SELECT range AS k FROM range(5)),
tp AS (SELECT t.id, 0.5 * {S.U('t.id', 'a')} + 0.5 * (('0x' || substring(md5(CAST(t.id AS VARCHAR) || ':' || CAST(k.k AS VARCHAR) || ':tp'), 1, 8))::BIGINT / 4294967296.0) AS p
       FROM t CROSS JOIN k WHERE t.part = 'test')
SELECT id, round(avg(p), 6) AS p FROM tp GROUP BY id""")
def q_test_pred_mean(spark, sf):
    t = T.syn_task(spark, sf)
    te = T.test_rows(t).select("id").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    key = F.concat(F.col("id").cast("string"), F.lit(":"), F.col("k").cast("string"))
    tp = te.select("id", "k", (0.5 * uniform("id", "a") + 0.5 * uniform(key, "tp")).alias("p"))
    return OOF.mean_prediction(tp).select("id", r6("p").alias("p"))


# ---------------------------------------------------------------- fitted blends / stacking
from foldwise.plans import stack as ST  # noqa: E402
from foldwise.operators import solvers as SV  # noqa: E402


def _syn_stack_inputs(spark, sf, names=("p1", "p2", "p3")):
    f, spec, t = _folded(spark, sf, "syn")
    oof_long = MB.binary_members(f, names=names)
    test_long = MB.binary_members(T.test_rows(t), names=names)
    return oof_long, test_long, f.select("id", "fold", "y"), spec


def _reg_stack_inputs(spark, sf):
    f, spec, t = _folded(spark, sf, "reg")
    return MB.regression_members(f), MB.regression_members(T.test_rows(t)), f.select("id", "fold", "y"), spec


def _mc_stack_inputs(spark, sf):
    t, spec = T.load_task(spark, sf, "mc")
    lm = fit_label_map(spark, T.train_rows(t))
    tc = lm.encode(t)
    f = FO.assign_folds(T.train_rows(tc), spec)
    # several fits and scores read the members of the train part
    return (materialize(MB.multiclass_members(f, lm.n_classes)), MB.multiclass_members(T.test_rows(tc), lm.n_classes),
            f.select("id", "fold", "code"), spec, lm)


def _weights_df(spark, W, members, kind="w"):
    rows = [(q, m, float(W[q][j]) + 0.0) for q in range(len(W)) for j, m in enumerate(members)]  # + 0.0: no minus zero
    return spark.createDataFrame(rows, f"problem int, member string, {kind} double")


META_PLAIN = f"""eq AS (SELECT id, fold, any_value(y) AS y, avg(p) AS p FROM mo WHERE member <> 'p1r' GROUP BY id, fold),
r AS (SELECT member, id, fold, y, (rank() OVER (PARTITION BY fold, member ORDER BY p) - 1
        + (count(*) OVER (PARTITION BY fold, member, p) + 1) / 2.0) / count(*) OVER (PARTITION BY fold, member) AS rr
      FROM mo WHERE member <> 'p1r'),
rm AS (SELECT id, any_value(y) AS y, round(avg(rr), 12) AS p FROM r GROUP BY id),
sc AS (SELECT 'equal' AS meta, auc AS oof_score FROM {S.auc_sql('eq', '')}
       UNION ALL SELECT 'rank_mean' AS meta, auc AS oof_score FROM {S.auc_sql('rm', '')})"""
META_OOF_SQL = f"WITH {SYN_OOF},\n{META_PLAIN}"


def _meta_oof_scores(spark, sf):
    oof_long, test_long, train, spec = _syn_stack_inputs(spark, sf)
    rows = []
    for name in ("equal", "rank_mean"):
        oof, _, _ = ST.meta_binary_or_regression(name, oof_long, test_long, train, MEMBERS3, 5, "binary")
        rows.append(M.auc(oof, []).select(F.lit(name).alias("meta"), F.col("auc").alias("oof_score")))
    return rows[0].unionByName(rows[1])


@query("meta_oof", META_OOF_SQL + "\nSELECT meta, round(oof_score, 6) AS oof_score FROM sc")
def q_meta_oof(spark, sf):
    return _meta_oof_scores(spark, sf).select("meta", r6("oof_score").alias("oof_score"))


@query("best_meta", META_OOF_SQL + "\nSELECT arg_max(meta, oof_score) AS best_meta, round(max(oof_score), 6) AS oof_score FROM sc")
def q_best_meta(spark, sf):
    s = _meta_oof_scores(spark, sf)
    return s.agg(F.max_by("meta", "oof_score").alias("best_meta"), r6(F.max("oof_score")).alias("oof_score"))


# With weights that add up to one the blend is a mixture, so its log loss is a mixture likelihood
# and the update w <- mean(w q / sum(w q)) climbs to the optimum; q is a member's probability of
# what happened.
EM_LAST = 600
EM_STEPS = f"""pw AS (SELECT q, a, b, c FROM mix JOIN pr ON mix.fold <> pr.q),
em AS (SELECT 0 AS step, q, 1 / 3.0 AS wa, 1 / 3.0 AS wb, 1 / 3.0 AS wc FROM pr
  UNION ALL
  SELECT any_value(step) + 1, em.q, avg(wa * a / (wa * a + wb * b + wc * c)), avg(wb * b / (wa * a + wb * b + wc * c)),
    avg(wc * c / (wa * a + wb * b + wc * c)) FROM em JOIN pw ON em.q = pw.q WHERE step < {EM_LAST} GROUP BY em.q)"""


def _mixture_sql(rows: str, members: list[str]) -> str:
    names = ", ".join(f"('{m}', {i})" for i, m in enumerate(members))
    return f"""WITH RECURSIVE {rows},
pr AS (SELECT CAST(range AS INTEGER) AS q FROM range(6)),
{EM_STEPS}
SELECT q AS problem, v.member, round(CASE v.i WHEN 0 THEN wa WHEN 1 THEN wb ELSE wc END, 3) + 0.0 AS w
FROM em, (VALUES {names}) v(member, i) WHERE step = {EM_LAST}"""


SYN_MIX_ROWS = """mix AS (SELECT fold, max(CASE WHEN y = 1 THEN p ELSE 1 - p END) FILTER (WHERE member = 'p1') AS a,
    max(CASE WHEN y = 1 THEN p ELSE 1 - p END) FILTER (WHERE member = 'p2') AS b,
    max(CASE WHEN y = 1 THEN p ELSE 1 - p END) FILTER (WHERE member = 'p3') AS c FROM mo GROUP BY id, fold)"""
SYN_MIX = f"{SYN_OOF},\n{SYN_MIX_ROWS}"
MC_MIX = f"""{MC_OOF},
mix AS (SELECT fold, max(probs[code + 1]) FILTER (WHERE member = 'c1') AS a, max(probs[code + 1]) FILTER (WHERE member = 'c2') AS b,
    max(probs[code + 1]) FILTER (WHERE member = 'c3') AS c FROM mo GROUP BY id, fold)"""


@query("blend_convex_logloss", _mixture_sql(SYN_MIX, MEMBERS3))
def q_blend_convex_logloss(spark, sf):
    oof_long, _, train, _ = _syn_stack_inputs(spark, sf)
    X = MM.member_matrix(oof_long, MEMBERS3).join(train, "id")
    W, loss, grad, passes = SV.convex_logloss_fit(X, MEMBERS3, "y", "fold", 5, kind="binary")
    return _weights_df(spark, np.round(W, 3), MEMBERS3)


# Newton steps on one coefficient after the other; the penalty spares the intercept.
LOGISTIC_ROWS = f"""WITH RECURSIVE {SYN_OOF},
z AS (SELECT id, fold, any_value(y) AS y, {', '.join(
    f"max(ln(least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6)))) FILTER (WHERE member = 'p{i}') AS x{i}" for i in (1, 2, 3))}
      FROM mo GROUP BY id, fold),
pr AS (SELECT CAST(range AS INTEGER) AS q FROM range(6)),
pz AS (SELECT q, y, x1, x2, x3 FROM z JOIN pr ON z.fold <> pr.q),
nt AS (SELECT 0 AS step, q, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, 0.0::DOUBLE AS b3 FROM pr
  UNION ALL
  SELECT step + 1, q, CASE WHEN step % 4 = 0 THEN b0 - g / h ELSE b0 END, CASE WHEN step % 4 = 1 THEN b1 - g / h ELSE b1 END,
    CASE WHEN step % 4 = 2 THEN b2 - g / h ELSE b2 END, CASE WHEN step % 4 = 3 THEN b3 - g / h ELSE b3 END
  FROM (SELECT step, q, b0, b1, b2, b3,
          sum((p - y) * x) + CASE step % 4 WHEN 0 THEN 0 WHEN 1 THEN b1 WHEN 2 THEN b2 ELSE b3 END AS g,
          sum(p * (1 - p) * x * x) + CASE step % 4 WHEN 0 THEN 0 ELSE 1 END AS h
        FROM (SELECT step, nt.q, b0, b1, b2, b3, y, CASE step % 4 WHEN 0 THEN 1 WHEN 1 THEN x1 WHEN 2 THEN x2 ELSE x3 END AS x,
                1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2 + b3 * x3))) AS p FROM nt JOIN pz ON nt.q = pz.q WHERE step < 800)
        GROUP BY step, q, b0, b1, b2, b3))"""
LOGISTIC_SQL = f"""{LOGISTIC_ROWS}
SELECT q AS problem, v.member, round(CASE v.i WHEN 0 THEN b0 WHEN 1 THEN b1 WHEN 2 THEN b2 ELSE b3 END, 3) + 0.0 AS coef
FROM nt, (VALUES ('intercept', 0), ('p1', 1), ('p2', 2), ('p3', 3)) v(member, i) WHERE step = 800"""

# Each row is scored by the fit of the problem that left its fold out; fitted weights agree to
# three digits, so the scores are compared to four.
META_SCORES_SQL = f"""{LOGISTIC_ROWS},
{SYN_MIX_ROWS},
{EM_STEPS},
lp AS (SELECT y, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2 + b3 * x3))) AS p FROM z JOIN nt ON nt.q = z.fold WHERE step = 800),
wide AS (SELECT fold, any_value(y) AS y, max(p) FILTER (WHERE member = 'p1') AS p1, max(p) FILTER (WHERE member = 'p2') AS p2,
  max(p) FILTER (WHERE member = 'p3') AS p3 FROM mo GROUP BY id, fold),
cp AS (SELECT y, wa * p1 + wb * p2 + wc * p3 AS p FROM wide JOIN em ON em.q = wide.fold WHERE step = {EM_LAST}),
{META_PLAIN}
SELECT meta, round(oof_score, 4) AS oof_score FROM (SELECT * FROM sc UNION ALL SELECT 'logistic', auc FROM {S.auc_sql('lp', '')}
  UNION ALL SELECT 'nnls', auc FROM {S.auc_sql('cp', '')})"""


@query("meta_scores", META_SCORES_SQL)
def q_meta_scores(spark, sf):
    oof_long, test_long, train, spec = _syn_stack_inputs(spark, sf)
    res = ST.stack(oof_long, test_long, train, MEMBERS3, 5, "binary", "auc", spec.cv_label())
    return spark.createDataFrame([(n, round(s, 4)) for n, s in res.scores], "meta string, oof_score double")


#: Members side by side with fold and target; problem q leaves fold q out, problem 5 has all rows.
REG_WIDE = f"""{REG_OOF},
w AS (SELECT id, fold, any_value(y) AS y, max(p) FILTER (WHERE member = 'r1') AS a, max(p) FILTER (WHERE member = 'r2') AS b,
        max(p) FILTER (WHERE member = 'r3') AS c FROM mo GROUP BY id, fold),
pr AS (SELECT CAST(range AS INTEGER) AS q FROM range(6)),
pw AS (SELECT q, y, a, b, c FROM w JOIN pr ON w.fold <> pr.q)"""

# The simplex has seven faces of three members. On each the minimum without bounds has a closed
# form; the best of those that lie within the simplex is the minimum.
CONVEX_MSE_SQL = f"""WITH {REG_WIDE},
mo2 AS (SELECT q, sum(pow(a - c, 2)) AS uu, sum((a - c) * (b - c)) AS uv, sum(pow(b - c, 2)) AS vv,
        sum((y - c) * (a - c)) AS uy, sum((y - c) * (b - c)) AS vy, sum(pow(a - b, 2)) AS dd, sum((y - b) * (a - b)) AS dy,
        sum(pow(y - c, 2)) AS yy FROM pw GROUP BY q),
face AS (SELECT q, 1.0 AS wa, 0.0 AS wb FROM mo2 UNION ALL SELECT q, 0.0, 1.0 FROM mo2 UNION ALL SELECT q, 0.0, 0.0 FROM mo2
  UNION ALL SELECT q, dy / dd, 1 - dy / dd FROM mo2 UNION ALL SELECT q, uy / uu, 0.0 FROM mo2 UNION ALL SELECT q, 0.0, vy / vv FROM mo2
  UNION ALL SELECT q, (uy * vv - vy * uv) / (uu * vv - uv * uv), (vy * uu - uy * uv) / (uu * vv - uv * uv) FROM mo2),
l AS (SELECT face.q, wa, wb, yy - 2 * (wa * uy + wb * vy) + wa * wa * uu + 2 * wa * wb * uv + wb * wb * vv AS loss
      FROM face JOIN mo2 USING (q) WHERE wa >= 0 AND wb >= 0 AND wa + wb <= 1),
best AS (SELECT q, arg_min(wa, loss) AS wa, arg_min(wb, loss) AS wb FROM l GROUP BY q)
SELECT q AS problem, v.member, round(CASE v.member WHEN 'r1' THEN wa WHEN 'r2' THEN wb ELSE 1 - wa - wb END, 4) AS w
FROM best, (VALUES ('r1'), ('r2'), ('r3')) v(member)"""

# Least squares by Cramer's rule on the centred moments.
LINEAR_SQL = f"""WITH {REG_WIDE},
mo2 AS (SELECT q, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, var_pop(a) AS aa, var_pop(b) AS bb, var_pop(c) AS cc,
        covar_pop(a, b) AS ab, covar_pop(a, c) AS ac, covar_pop(b, c) AS bc, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_,
        covar_pop(c, y) AS cy FROM pw GROUP BY q),
d AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM mo2),
s AS (SELECT *, (ay * (bb * cc - bc * bc) - ab * (by_ * cc - bc * cy) + ac * (by_ * bc - bb * cy)) / det AS wa,
        (aa * (by_ * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - by_ * ac)) / det AS wb,
        (aa * (bb * cy - by_ * bc) - ab * (ab * cy - by_ * ac) + ay * (ab * bc - bb * ac)) / det AS wc FROM d)
SELECT q AS problem, v.member, CASE v.member WHEN 'r1' THEN round(wa, 4) WHEN 'r2' THEN round(wb, 4) WHEN 'r3' THEN round(wc, 4)
  ELSE round(my - wa * ma - wb * mb - wc * mc, 2) END AS coef FROM s, (VALUES ('intercept'), ('r1'), ('r2'), ('r3')) v(member)"""


@query("blend_convex_mse", CONVEX_MSE_SQL)
def q_blend_convex_mse(spark, sf):
    oof_long, _, train, _ = _reg_stack_inputs(spark, sf)
    ms = ["r1", "r2", "r3"]
    X = MM.member_matrix(oof_long, ms).join(train, "id")
    S = SV.fold_moments(X, ms, "y", "fold", 5)
    W = np.array([SV.mse_simplex_fit(S[q], 3) for q in range(6)])
    return _weights_df(spark, np.round(W, 4), ms)


@query("blend_linear", LINEAR_SQL)
def q_blend_linear(spark, sf):
    oof_long, _, train, _ = _reg_stack_inputs(spark, sf)
    ms = ["r1", "r2", "r3"]
    X = MM.member_matrix(oof_long, ms).join(train, "id")
    S = SV.fold_moments(X, ms, "y", "fold", 5)
    B = np.array([SV.ols_fit(S[q], 3) for q in range(6)])
    B = np.concatenate([np.round(B[:, :1], 2), np.round(B[:, 1:], 4)], axis=1)  # the target is in the 100,000s
    return _weights_df(spark, B, ["intercept"] + ms, "coef")


@query("blend_logistic", LOGISTIC_SQL)
def q_blend_logistic(spark, sf):
    oof_long, _, train, _ = _syn_stack_inputs(spark, sf)
    X = MM.member_matrix(oof_long, MEMBERS3).join(train, "id")
    zs = [f"z_{m}" for m in MEMBERS3]
    Xz = X.select("id", "fold", "y", *[X_logit(m).alias(z) for m, z in zip(MEMBERS3, zs)])
    B, grad, passes = SV.logistic_fit(Xz, zs, "y", "fold", 5, C=1.0)
    return _weights_df(spark, np.round(B, 3), ["intercept"] + MEMBERS3, "coef")


X_logit = X.logit


@query("mc_blend_convex", _mixture_sql(MC_MIX, ["c1", "c2", "c3"]))
def q_mc_blend_convex(spark, sf):
    oof_long, test_long, train, spec, lm = _mc_stack_inputs(spark, sf)
    oof, test, det = ST.meta_multiclass("nnls", oof_long, test_long, train, ["c1", "c2", "c3"], 5, lm.n_classes)
    return _weights_df(spark, np.round(det["weights"], 3), ["c1", "c2", "c3"])


# The fit is strictly convex in the weights, so a zero gradient is the optimum.
@query("mc_blend_multinomial", f"""WITH {MC_OOF}, c AS (SELECT DISTINCT code FROM f),
x AS (SELECT unnest(range(0, 1 + 3 * (SELECT count(*) FROM c))) AS feature)
SELECT CAST(p.range AS INTEGER) AS problem, c.code, CAST(x.feature AS INTEGER) AS feature, true AS gradient_is_zero FROM range(6) p, c, x""")
def q_mc_blend_multinomial(spark, sf):
    """The gradient of every fold's fit at its weights, added up anew from the predictions of its rows."""
    oof_long, test_long, train, spec, lm = _mc_stack_inputs(spark, sf)
    ms, K = ["c1", "c2", "c3"], lm.n_classes
    _, _, det = ST.meta_multiclass("multinomial", oof_long, test_long, train, ms, 5, K)
    X = oof_long.groupBy("id").agg(*[F.first(F.when(F.col("member") == m, F.col("probs")), ignorenulls=True).alias(m) for m in ms])
    X = X.select("id", F.concat(*ms).alias("x")).join(train, "id")
    w, d = det["coef"], 1 + len(ms) * K

    def kernel(x):
        g = np.zeros((6, K, d))
        for q in range(6):
            own = x[x[:, 0] != q]  # problem 5 has all rows
            f = np.concatenate([np.ones((len(own), 1)), own[:, 2:]], axis=1)
            e = np.exp(f @ w[q].T)
            r = e / e.sum(axis=1, keepdims=True) - (own[:, 1:2] == np.arange(K))
            g[q] = r.T @ f
        return g.ravel()

    g = SV.block_sums(X, ["fold", "code"], kernel, 6 * K * d, vector="x").reshape(6, K, d)
    g[:, :, 1:] += w[:, :, 1:]  # the penalty spares the intercept
    rows = [(q, k, j, bool(abs(g[q, k, j]) < 1e-4)) for q in range(6) for k in range(K) for j in range(d)]
    return spark.createDataFrame(rows, "problem int, code int, feature int, gradient_is_zero boolean")


def _stack_q(res, greater, mc=False):
    """Every train row with a prediction in range, from a meta at least as good as the plain mean."""
    b, equal = res.best, dict(res.scores)["equal"]
    good = b.oof_score >= equal if greater else b.oof_score <= equal
    fits = F.forall("probs", lambda x: x.between(0, 1)) if mc else F.col("p").isNotNull() & ~F.isnan("p")
    return b.oof.select("id", "fold", fits.alias("in_range"), F.lit(bool(good)).alias("no_worse"))


@query("stack_binary", f"""WITH {S.folded('syn')}
SELECT id, true AS in_range, true AS no_worse FROM f""")
def q_stack_binary(spark, sf):
    oof_long, test_long, train, spec = _syn_stack_inputs(spark, sf)
    t = T.syn_task(spark, sf)
    job = ST.stack_job(spark, oof_long, test_long, train, T.test_rows(t).select("id"), MEMBERS3, spec)
    good = job.result.best.oof_score >= dict(job.result.scores)["equal"]
    return job.oof_table.select("id", F.col("oof").between(0, 1).alias("in_range"), F.lit(bool(good)).alias("no_worse"))


@query("stack_regression", f"""WITH {S.folded('reg', strategy='KFold')}
SELECT id, fold, true AS in_range, true AS no_worse FROM f""")
def q_stack_regression(spark, sf):
    oof_long, test_long, train, spec = _reg_stack_inputs(spark, sf)
    return _stack_q(ST.stack(oof_long, test_long, train, ["r1", "r2", "r3"], 5, "regression", "rmse", spec.cv_label()), False)


@query("stack_multiclass", f"""WITH {MC_OOF}
SELECT id, fold, true AS in_range, true AS no_worse FROM f""")
def q_stack_multiclass(spark, sf):
    oof_long, test_long, train, spec, lm = _mc_stack_inputs(spark, sf)
    res = ST.stack(oof_long, test_long, train, ["c1", "c2", "c3"], 5, "multiclass", "logloss", spec.cv_label(),
                   n_classes=lm.n_classes)
    return _stack_q(res, False, mc=True)


# ---------------------------------------------------------------- run logs / ledger / views
from foldwise.operators import runs as RU  # noqa: E402
from foldwise.plans import experiments as EX  # noqa: E402

RUNS = S.runs_ctes()


@query("log_table", f"""WITH {RUNS}
SELECT exp_id, model, cv_mean, cv_std, lb_score, CAST(n_feat AS INTEGER) AS n_feat, feature_builder,
  substring(notes, 1, 60) AS notes, timestamp FROM logs""")
def q_log_table(spark, sf):
    raw, _ = EX.load_runs(spark, sf)
    return RU.flatten_logs(raw)


@query("log_record", f"""WITH {S.runs_ctes(iterations=True)}
SELECT exp_id, cv_strategy, cv_mean, cv_std, CAST(len(cv_scores) AS INTEGER) AS k, round(list_sum(cv_scores), 6) AS sum_scores,
  list_max(best_iters) AS max_iter FROM rec""")
def q_log_record(spark, sf):
    rec = RU.log_records(EX.run_fold_scores(spark, sf), EX.run_table(spark))
    return rec.select("exp_id", "cv_strategy", "cv_mean", "cv_std", F.size("cv_scores").alias("k"),
                      r6(F.aggregate("cv_scores", F.lit(0.0), lambda a, x: a + x)).alias("sum_scores"),
                      F.array_max("best_iters").alias("max_iter"))


@query("ledger_sync", f"""WITH {RUNS}
SELECT exp_id, lb_score FROM logs""")
def q_ledger_sync(spark, sf):
    raw, _ = EX.load_runs(spark, sf)
    return raw.select("exp_id", "lb_score")


@query("leaderboard", f"""WITH {RUNS}
SELECT exp_id, cv_mean, lb_score, CAST(row_number() OVER (ORDER BY cv_mean DESC NULLS LAST, exp_id) AS INTEGER) AS position FROM logs""")
def q_leaderboard(spark, sf):
    raw, _ = EX.load_runs(spark, sf)
    lb = RU.leaderboard(RU.flatten_logs(raw), "cv_mean", "auc")
    return lb.select("exp_id", "cv_mean", "lb_score", "position")


@query("log_filter", f"""WITH {RUNS}
SELECT exp_id, model, cv_mean FROM logs WHERE lower(model) = 'lgbm' AND contains(exp_id, 'exp_') AND exp_id <> 'exp_006'""")
def q_log_filter(spark, sf):
    raw, _ = EX.load_runs(spark, sf)
    return RU.log_filter(raw, "LgBm", "exp_", exclude="exp_006").select("exp_id", "model", "cv_mean")


@query("recent_runs", f"""WITH {RUNS}
SELECT exp_id, timestamp, cv_mean, lb_score FROM logs WHERE lower(model) = 'lgbm' AND exp_id <> 'exp_007'
ORDER BY timestamp DESC NULLS LAST, exp_id LIMIT 3""")
def q_recent_runs(spark, sf):
    raw, _ = EX.load_runs(spark, sf)
    return RU.recent_runs(RU.log_filter(raw, "lgbm", exclude="exp_007"), 3).select("exp_id", "timestamp", "cv_mean", "lb_score")


@query("anchor_run", f"""WITH {RUNS}
SELECT exp_id, 'named' AS kind, cv_mean, cv_std FROM logs WHERE exp_id = 'exp_003'
UNION ALL
(SELECT exp_id, 'recent' AS kind, cv_mean, cv_std FROM logs WHERE lower(model) = 'lgbm' AND exp_id <> 'exp_007'
 ORDER BY timestamp DESC NULLS LAST, exp_id LIMIT 1)""")
def q_anchor_run(spark, sf):
    raw, _ = EX.load_runs(spark, sf)
    group = RU.log_filter(raw, "lgbm", exclude="exp_007")
    named = RU.anchor_run(raw, group, "exp_003").select("exp_id", F.lit("named").alias("kind"), "cv_mean", "cv_std")
    recent = RU.anchor_run(raw, group, "no_such_run").select("exp_id", F.lit("recent").alias("kind"), "cv_mean", "cv_std")
    return named.unionByName(recent)


@query("fold_noise", f"""WITH {RUNS},
e AS (SELECT exp_id, unnest(cv_scores) AS s FROM logs)
SELECT exp_id, count(s) AS k, round(avg(s), 6) AS mean, round(stddev_samp(s), 6) AS std,
  round(stddev_samp(s) / sqrt(count(s)), 6) AS se FROM e GROUP BY exp_id HAVING count(s) >= 2""")
def q_fold_noise(spark, sf):
    raw, _ = EX.load_runs(spark, sf)
    n = RU.fold_noise(raw)
    return n.select("exp_id", "k", r6("mean").alias("mean"), r6("std").alias("std"), r6("se").alias("se"))


@query("noise_floor", f"""WITH {RUNS},
e AS (SELECT exp_id, unnest(cv_scores) AS s FROM logs WHERE exp_id = 'exp_001'),
a AS (SELECT count(s) AS k, stddev_samp(s) / sqrt(count(s)) AS se FROM e),
g AS (SELECT count(cv_mean) AS n_group, min(cv_mean) AS g_min, max(cv_mean) AS g_max, stddev_samp(cv_mean) AS g_std
      FROM logs WHERE lower(model) = 'lgbm' AND exp_id <> 'exp_001' AND cv_mean IS NOT NULL)
SELECT 'exp_001' AS anchor, a.k, round(a.se, 6) AS se, round(2 * a.se, 6) AS two_se, g.n_group,
  round(g.g_max - g.g_min, 6) AS g_spread, round(g.g_std, 6) AS g_std FROM a, g""")
def q_noise_floor(spark, sf):
    raw, _ = EX.load_runs(spark, sf)
    anchor = raw.where(F.col("exp_id") == "exp_001")
    group = RU.log_filter(raw, "lgbm", exclude="exp_001")
    nf = RU.noise_floor(anchor, group)
    return nf.select("anchor", "k", r6("se").alias("se"), r6("two_se").alias("two_se"), "n_group",
                     r6("g_spread").alias("g_spread"), r6("g_std").alias("g_std"))


@query("regime_check", f"""WITH {RUNS},
sets AS (SELECT * FROM (VALUES ('a', 'exp_001'), ('a', 'exp_002'), ('b', 'exp_001'), ('b', 'exp_003'),
  ('c', 'exp_001'), ('c', 'exp_005'), ('d', 'exp_001'), ('d', 'exp_404')) v(s, exp_id)),
j AS (SELECT sets.s, logs.cv_strategy, logs.cv_mean FROM sets LEFT JOIN logs ON sets.exp_id = logs.exp_id),
a AS (SELECT s, count(*) FILTER (WHERE cv_strategy IS NULL) AS n_missing, count(DISTINCT coalesce(cv_strategy, '')) AS n_labels,
        any_value(cv_strategy) AS label, max(cv_mean) AS best_member FROM j GROUP BY s)
SELECT s AS member_set, CASE WHEN n_missing > 0 THEN 'fallback' WHEN n_labels > 1 THEN 'mismatch'
  WHEN regexp_matches(label, '^(StratifiedKFold|KFold|GroupKFold)_[0-9]+$') THEN 'ok' ELSE 'fallback' END AS status, best_member FROM a""")
def q_regime_check(spark, sf):
    raw, _ = EX.load_runs(spark, sf)
    sets = {"a": ["exp_001", "exp_002"], "b": ["exp_001", "exp_003"], "c": ["exp_001", "exp_005"],
            "d": ["exp_001", "exp_404"]}
    out = None
    for name, ms in sets.items():
        best = raw.where(F.col("exp_id").isin(ms)).agg(F.max("cv_mean").alias("best_member"))
        r = with_scalars(RU.resolve_regime(raw, ms, ("StratifiedKFold", 5)), best).select(
            F.lit(name).alias("member_set"), "status", "best_member")
        out = r if out is None else out.unionByName(r)
    return out


# ---------------------------------------------------------------- integrity
from foldwise.operators import integrity as IG  # noqa: E402
from foldwise.session import scratch_path, with_scalars  # noqa: E402


@query("split_check", f"""WITH {S.folded('bin')}
SELECT count(*) AS n_split, count(*) AS n_data, min(fold) AS min_fold, max(fold) AS max_fold,
  count(DISTINCT fold) AS n_labels, CAST(0 AS BIGINT) AS n_extra, CAST(0 AS BIGINT) AS n_missing,
  CAST(0 AS BIGINT) AS n_target_changed, true AS ok FROM f""")
def q_split_check(spark, sf):
    t, spec = T.load_task(spark, sf, "bin")
    tr = T.train_rows(t)
    root = scratch_path(spark, "splits")
    split = IG.get_or_create_split(spark, tr, spec, root)          # creates and stores
    again = IG.get_or_create_split(spark, tr, spec, root)          # loads and self-checks
    stored = IG.read_split(spark, root, IG.split_regime(tr, spec))
    rep = IG.split_report(stored, tr, spec.n_folds)
    return rep.select(*[F.col(c).cast("long").alias(c) if c not in ("min_fold", "max_fold", "ok") else F.col(c)
                        for c in rep.columns]).where(F.lit(split is not None and again is not None))


@query("attach_split", f"""WITH {S.folded('bin')}
SELECT t.id, f.fold, round(t.value, 6) AS value FROM t JOIN f ON t.id = f.id""")
def q_attach_split(spark, sf):
    t, spec = T.load_task(spark, sf, "bin")
    tr = T.train_rows(t)
    split = IG.get_or_create_split(spark, tr, spec, scratch_path(spark, "splits"))
    return IG.attach_split(t, split).select("id", "fold", r6("value").alias("value"))


@query("group_split_roundtrip", f"""WITH {S.folded('grp', strategy='GroupKFold')}
SELECT id, user_id, fold FROM f""")
def q_group_split_roundtrip(spark, sf):
    t, spec = T.load_task(spark, sf, "grp")
    tr = T.train_rows(t)
    store = scratch_path(spark, "splits")
    IG.get_or_create_split(spark, tr, spec, store)
    loaded = IG.load_split(spark, store, IG.split_regime(tr.repartition(5), spec), tr)
    return IG.attach_split(tr, loaded).select("id", "user_id", "fold")


def _fp_sql(src_cols):
    parts = " || ".join(f"'{c}=' || coalesce(CAST({c} AS VARCHAR), '\\N') || ';'" for c in sorted(src_cols))
    return f"('0x' || substring(md5({parts}), 1, 8))::BIGINT"


@query("fold_fingerprint", f"""WITH {S.folded('imb')},
ks AS (SELECT CAST(range AS INTEGER) AS k FROM range(5)),
r AS (SELECT ks.k, 'fit' AS role, {_fp_sql(['id', 'lang', 'n_chars', 'source', 'y'])} AS h FROM f JOIN ks ON f.fold <> ks.k
      UNION ALL SELECT f.fold AS k, 'valid' AS role, {_fp_sql(['id', 'lang', 'n_chars', 'source'])} AS h FROM f
      UNION ALL SELECT ks.k, 'predict' AS role, {_fp_sql(['id', 'lang', 'n_chars', 'source'])} AS h FROM t CROSS JOIN ks WHERE part = 'test')
SELECT k, role, count(*) AS n, bit_xor(h) AS x, CAST(sum(h) AS BIGINT) AS s FROM r GROUP BY k, role""")
def q_fold_fingerprint(spark, sf):
    f, spec, t = _folded(spark, sf, "imb")
    ks = F.sequence(F.lit(0), F.lit(spec.n_folds - 1))
    feats = ["id", "lang", "n_chars", "source"]
    fit = f.withColumn("k", F.explode(F.filter(ks, lambda k: k != F.col("fold"))))
    predict = T.test_rows(t).withColumn("k", F.explode(ks))
    parts = [("fit", fit, [*feats, "y"]), ("valid", f.withColumn("k", F.col("fold")), feats), ("predict", predict, feats)]
    prints = [IG.fingerprint(d.withColumn("role", F.lit(role)), ["k", "role"], cols) for role, d, cols in parts]
    return prints[0].unionByName(prints[1]).unionByName(prints[2]).select("k", "role", "n", "x", F.col("s").cast("long").alias("s"))


@query("fingerprint_diff", f"""WITH {S.folded('imb')},
a AS (SELECT fold AS k, count(*) AS n, bit_xor(h) AS x, sum(h) AS s FROM (SELECT fold, {_fp_sql(['id', 'lang', 'source', 'y'])} AS h FROM f) GROUP BY fold),
b AS (SELECT fold AS k, count(*) AS n, bit_xor(h) AS x, sum(h) AS s FROM (SELECT fold, {_fp_sql(['id', 'lang', 'source', 'y'])} AS h FROM f
      WHERE NOT (fold = 2 AND {S.U('id', 'drop')} < 0.05)) GROUP BY fold)
SELECT coalesce(a.k, b.k) AS k, a.n AS n_before, b.n AS n_after FROM a FULL OUTER JOIN b ON a.k = b.k
WHERE NOT coalesce(a.n = b.n AND a.x = b.x AND a.s = b.s, false)""")
def q_fingerprint_diff(spark, sf):
    f, _, _ = _folded(spark, sf, "imb")
    cols = ["id", "lang", "source", "y"]
    before = IG.fingerprint(f.withColumn("k", F.col("fold")), ["k"], cols)
    changed = f.where(~((F.col("fold") == 2) & (uniform("id", "drop") < 0.05)))
    after = IG.fingerprint(changed.withColumn("k", F.col("fold")), ["k"], cols)
    return IG.fingerprint_diff(before, after, ["k"])


# ---------------------------------------------------------------- model training (property checks)
from dataclasses import replace as _replace  # noqa: E402

from foldwise.plans.trainers import get_trainer  # noqa: E402


def _syn_model_task(spark, sf):
    t = T.with_planted_features(T.syn_task(spark, sf))
    spec = _replace(T.SPECS["syn"], te_cols=("user_id",))
    return t, spec


# A fitted model has no SQL twin. What SQL can say of its run is checked: every train row once, in
# its fold, with a prediction in range, and the score gate of the planted signal.
FOLD_GATE = f"""WITH {S.folded('syn')}
SELECT fold, count(*) AS n, true AS above_gate FROM f GROUP BY fold"""


def _fold_gate(run, gate=0.8):
    n = run.oof.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    return run.fold_scores.join(n, "fold").select("fold", "n", (F.col("score") > gate).alias("above_gate"))


def _sums_to_one(df):
    total = F.aggregate("probs", F.lit(0.0), lambda a, x: a + x)
    return df.select("id", "fold", (F.abs(total - 1) < 1e-9).alias("sums_to_one"))


@query("oof_binary", f"""WITH {S.folded('syn')}
SELECT id, fold, true AS in_range FROM f""")
def q_oof_binary(spark, sf):
    t, spec = _syn_model_task(spark, sf)
    run = OOF.run_oof(spark, t, spec, get_trainer("gbt", maxIter=20, maxDepth=3), ["value", "s_a", "s_n"])
    return run.oof.select("id", "fold", F.col("p").between(0, 1).alias("in_range"))


@query("oof_gbt", FOLD_GATE)
def q_oof_gbt(spark, sf):
    t, spec = _syn_model_task(spark, sf)
    run = OOF.run_oof(spark, t, spec, get_trainer("gbt", maxIter=20, maxDepth=3, patience=5),
                      ["value", "s_a", "s_n"], early_stopping=True)
    return _fold_gate(run)


@query("oof_rf", FOLD_GATE)
def q_oof_rf(spark, sf):
    t, spec = _syn_model_task(spark, sf)
    return _fold_gate(OOF.run_oof(spark, t, spec, get_trainer("rf", numTrees=30), ["value", "s_a", "s_n"]))


@query("oof_linear", FOLD_GATE)
def q_oof_linear(spark, sf):
    t, spec = _syn_model_task(spark, sf)
    return _fold_gate(OOF.run_oof(spark, t, spec, get_trainer("linear"), ["value", "s_a", "s_n"]))


@query("oof_regression", f"""WITH {S.folded('reg', strategy='KFold')}
SELECT id, fold, true AS in_range FROM f""")
def q_oof_regression(spark, sf):
    t, spec = T.load_task(spark, sf, "reg")
    t = T.with_order_features(spark, sf, t)
    run = OOF.run_oof(spark, t, spec, get_trainer("rf", numTrees=20), ["n_lines", "net_value", "hint"])
    ends = T.train_rows(t).agg(F.min("y").alias("lo"), F.max("y").alias("hi"))  # means of targets stay within
    return with_scalars(run.oof, ends).select("id", "fold", F.col("p").between(F.col("lo"), F.col("hi")).alias("in_range"))


@query("oof_multiclass", f"""WITH {S.folded('vec')}
SELECT id, fold, true AS sums_to_one FROM f""")
def q_oof_multiclass(spark, sf):
    t, spec = T.load_task(spark, sf, "vec")
    run = OOF.run_oof(spark, t, spec, get_trainer("linear", regParam=0.01), [], vector_col="embedding")
    return _sums_to_one(run.oof)


from foldwise.plans import job as JOB  # noqa: E402


def _named_job(spark, sf, store, exp_id="run_a", **kw):
    """A training job over a task whose key and target are not called id and y."""
    t = T.with_planted_features(T.syn_task(spark, sf)).withColumnsRenamed({"id": "row_key", "y": "target"})
    spec = _replace(T.SPECS["syn"], id_col="row_key", target_col="target", te_cols=("user_id",), drop_cols=("ts",))
    args = {"numeric": ["value", "s_a"], "ratio": ("s_a", "s_n")}
    return t, spec, JOB.train_job(spark, t, spec, get_trainer("linear", **kw), store, exp_id, builder="row_example", builder_args=args)


@query("sweep_scores", f"""WITH {S.folded('syn')}
SELECT params, 'StratifiedKFold_' || (max(fold) + 1) AS cv_strategy, true AS above_gate
FROM f, (VALUES ('regParam=0.0'), ('regParam=0.05')) v(params) GROUP BY params""")
def q_sweep_scores(spark, sf):
    """Two settings over one split and one encoding, each with its own log record."""
    t, spec = _syn_model_task(spark, sf)
    settings = {f"reg_{i}": get_trainer("linear", regParam=reg) for i, reg in enumerate((0.0, 0.05))}
    jobs = JOB.sweep(spark, t, _replace(spec, drop_cols=("ts",)), settings, scratch_path(spark, "sweep"))
    params = spark.createDataFrame([("reg_0", "regParam=0.0"), ("reg_1", "regParam=0.05")], "exp_id string, params string")
    logs = RU.read_raw_logs(spark, jobs["reg_0"].path("logs")).select("exp_id", "cv_strategy", "cv_mean")
    return logs.join(params, "exp_id").select("params", "cv_strategy", (F.col("cv_mean") > 0.8).alias("above_gate"))


@query("unconverged_folds", f"""WITH {S.folded('syn')}
SELECT DISTINCT 'two_rounds' AS exp_id, fold, 2 AS best_iter FROM f""")
def q_unconverged_folds(spark, sf):
    """From the logs of trained runs: two rounds are too few in every fold; a linear run has no rounds."""
    t, spec = _syn_model_task(spark, sf)
    t, spec, store = t.drop("ts"), _replace(spec, te_cols=(), drop_cols=("user_id",)), scratch_path(spark, "job")
    JOB.train_job(spark, t, spec, get_trainer("gbt", maxIter=2, maxDepth=2), store, "two_rounds", early_stopping=True)
    job = JOB.train_job(spark, t, spec, get_trainer("linear"), store, "linear", max_folds=1)
    return RU.unconverged_folds(RU.read_raw_logs(spark, job.path("logs")), 2).select("exp_id", "fold", "best_iter")


@query("oof_contract", f"""WITH {S.folded('syn')}
SELECT id AS row_key, fold, true AS in_range FROM f""")
def q_oof_contract(spark, sf):
    store = scratch_path(spark, "job")
    t, spec, job = _named_job(spark, sf, store)
    train = t.where(F.col("part") == "train")
    split = IG.get_or_create_split(spark, train, spec, f"{store}/splits")
    oof = spark.read.parquet(job.path("oof"))
    return oof.join(split, "row_key").select("row_key", "fold", F.col("oof").between(0, 1).alias("in_range"))


@query("job_log", f"""WITH {S.folded('syn')}
SELECT 'run_a' AS exp_id, 'StratifiedKFold_5' AS cv_strategy, fold, count(*) AS n, true AS equal, true AS above_gate FROM f GROUP BY fold""")
def q_job_log(spark, sf):
    """The logged fold scores, read back, against the AUC of the stored OOF table on the stored split."""
    store = scratch_path(spark, "job")
    t, spec, job = _named_job(spark, sf, store)
    train = t.where(F.col("part") == "train").select("row_key", "target")
    split = IG.get_or_create_split(spark, train, spec, f"{store}/splits")
    rows = spark.read.parquet(job.path("oof")).join(split, "row_key").join(train, "row_key")
    auc = M.auc(rows, ["fold"], y="target", p="oof").join(rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n")), "fold")
    logged = RU.read_raw_logs(spark, job.path("logs")).select(
        "exp_id", "cv_strategy", F.posexplode("cv_scores").alias("fold", "score"))
    return logged.join(auc, "fold").select("exp_id", "cv_strategy", "fold", "n", (F.abs(F.col("score") - F.col("auc")) < 1e-6).alias("equal"),
                                           (F.col("auc") > 0.8).alias("above_gate"))


@query("job_submission", f"""WITH t AS ({S.TASKS['syn']})
SELECT id AS row_key, true AS in_range FROM t WHERE part = 'test'""")
def q_job_submission(spark, sf):
    _, _, job = _named_job(spark, sf, scratch_path(spark, "job"))
    return spark.read.parquet(job.path("submission")).select("row_key", F.col("target").between(0, 1).alias("in_range"))


@query("oof_categorical", f"""WITH {S.folded('imb')}
SELECT id, true AS in_range FROM f""")
def q_oof_categorical(spark, sf):
    """Trees over nominal categories, with missing values in a category and a number."""
    t, spec = T.load_task(spark, sf, "imb")
    t = t.withColumns({"lang": F.when(uniform("id", "gap") >= 0.1, F.col("lang")),
                       "n_chars": F.when(uniform("id", "gap2") >= 0.1, F.col("n_chars"))})
    run = OOF.run_oof(spark, t, spec, get_trainer("gbt", maxIter=3, maxDepth=3), ["n_chars"], categorical=["lang", "source"])
    return OOF.oof_table(run).select("id", F.col("oof").between(0, 1).alias("in_range"))


@query("mc_missing_class", f"""WITH {S.mc_ctes()}
SELECT id, true AS sums_to_one FROM tc WHERE part = 'train'""")
def q_mc_missing_class(spark, sf):
    """A class all of whose rows are in one fold: the model of that fold never sees it."""
    t, spec = T.load_task(spark, sf, "mc")
    tr = T.train_rows(t)
    split = FO.assign_folds(tr, spec).select("id", "y", "fold")
    split = split.select("id", F.when(F.col("y") == "5-LOW", F.lit(0)).otherwise(F.col("fold")).alias("fold"))
    run = OOF.run_oof(spark, t, spec, get_trainer("linear", maxIter=5), ["o_totalprice"], split=split)
    wide = OOF.oof_table(run)
    total = sum((F.col(f"`{c}`") for c in wide.columns[1:]), F.lit(0.0))
    return wide.select("id", (F.abs(total - 1) < 1e-9).alias("sums_to_one"))


@query("oof_write_shape", f"""WITH {S.mc_ctes()},
c1 AS (SELECT id, probs FROM mm WHERE member = 'c1' AND id IN (SELECT id FROM tc WHERE part = 'train'))
SELECT id, {', '.join(f'round(probs[{i + 1}], 6) AS "oof_{c}"' for i, c in enumerate(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']))}
FROM c1""")
def q_oof_write_shape(spark, sf):
    t = T.mc_task(spark, sf)
    lm = fit_label_map(spark, T.train_rows(t))
    tc = lm.encode(T.train_rows(t))
    c1 = MB.multiclass_members(tc, lm.n_classes).where(F.col("member") == "c1")
    wide = OOF.probs_wide(c1, lm.classes, "oof_")
    path = scratch_path(spark, "oof")
    OOF.write_table(wide, path)
    back = spark.read.parquet(path)
    return back.select("id", *[r6(F.col(f"`oof_{c}`")).alias(f"oof_{c}") for c in lm.classes])


@query("submission", f"""WITH t AS ({S.TASKS['syn']})
SELECT id, round({S.BIN_MEMBERS['p1']}, 6) AS y FROM t WHERE part = 'test'""")
def q_submission(spark, sf):
    t = T.syn_task(spark, sf)
    template = T.test_rows(t).select("id", F.lit(0.0).alias("y"))
    pred = MB.binary_members(T.test_rows(t), names=("p1",)).select("id", F.col("p").alias("pred"))
    sub = OOF.submission(template, pred, "id", "y")
    OOF.check_submission(sub, template, "id", "y")
    return sub.select("id", r6("y").alias("y"))


@query("submission_template", f"""WITH t AS ({S.TASKS['syn']})
SELECT id, round({S.BIN_MEMBERS['p1']}, 6) AS y FROM t WHERE part = 'test'""")
def q_submission_template(spark, sf):
    """A template file in CSV says which keys a submission has."""
    t, path = T.test_rows(T.syn_task(spark, sf)), f"{scratch_path(spark, 'template')}.csv"
    t.select("id", F.lit(0.0).alias("y")).write.option("header", True).csv(path)
    pred = MB.binary_members(t, names=("p1",)).select("id", F.col("p").alias("pred"))
    return OOF.submission(OOF.read_template(spark, path, "id"), pred, "id", "y").select("id", r6("y").alias("y"))


@query("read_pred", f"""WITH t AS ({S.TASKS['syn']})
SELECT 'parquet' AS kind, id, round({S.BIN_MEMBERS['p1']}, 6) AS oof FROM t WHERE part = 'train'
UNION ALL SELECT 'csv' AS kind, id, round({S.BIN_MEMBERS['p2']}, 6) AS oof FROM t WHERE part = 'train'""")
def q_read_pred(spark, sf):
    """Prediction tables by name, one stored as Parquet and one as CSV."""
    t, folder = T.train_rows(T.syn_task(spark, sf)), scratch_path(spark, "preds")
    p = {m: MB.binary_members(t, names=(m,)).select("id", F.col("p").alias("oof")) for m in ("p1", "p2")}
    p["p1"].write.parquet(f"{folder}/one.parquet")
    p["p2"].write.option("header", True).csv(f"{folder}/two.csv")
    both = [read_pred(spark, folder, name).select(F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"), r6("oof").alias("oof"))
            for name, kind in (("one", "parquet"), ("two", "csv"))]
    return both[0].unionByName(both[1])


@query("source_rows", f"""WITH t AS ({S.TASKS['bin']})
SELECT count(*) AS n_rows, (SELECT count(DISTINCT o_orderpriority) FROM orders) AS n_classes FROM t WHERE part = 'source'""")
def q_source_rows(spark, sf):
    """The checks of a run's inputs: the rows that a source should have, the classes that are declared."""
    src = T.source_rows(T.bin_task(spark, sf))
    n = IG.check_row_count(src, src.agg(F.count(F.lit(1)).alias("n")).first().n, "source")
    lm = fit_label_map(spark, T.train_rows(T.mc_task(spark, sf)), n_classes=5)
    return src.agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") == n).withColumn("n_classes", F.lit(lm.n_classes).cast("long"))


@query("saved_models", f"""WITH {S.folded('syn')}
SELECT id, fold, true AS equal FROM f""")
def q_saved_models(spark, sf):
    """The saved model of each fold, loaded again, predicts the stored OOF values."""
    from pyspark.ml.classification import LogisticRegressionModel
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    t, spec = _syn_model_task(spark, sf)
    t, spec, store = t.drop("ts", "value"), _replace(spec, te_cols=(), drop_cols=("user_id",)), scratch_path(spark, "job")
    job = JOB.train_job(spark, t, spec, get_trainer("linear"), store, "kept", keep_models=True)
    split = IG.get_or_create_split(spark, T.train_rows(t), spec, f"{store}/splits")
    rows = VectorAssembler(inputCols=["s_a", "s_n"], outputCol="features").transform(T.train_rows(t).join(split, "id"))
    out = None
    for k in range(spec.n_folds):
        model = LogisticRegressionModel.load(f"{store}/models/kept_fold{k}")
        p = model.transform(rows.where(F.col("fold") == k)).select("id", "fold", F.element_at(vector_to_array("probability"), 2).alias("p"))
        out = p if out is None else out.unionByName(p)
    oof = spark.read.parquet(job.path("oof"))
    return out.join(oof, "id").select("id", "fold", (F.abs(F.col("p") - F.col("oof")) < 1e-12).alias("equal"))


@query("test_probabilities", f"""WITH {S.mc_ctes()}
SELECT id, true AS sums_to_one, true AS is_best FROM tc WHERE part = 'test'""")
def q_test_probabilities(spark, sf):
    """A multiclass run stores the test probabilities that its submitted labels are the highest of."""
    t, spec = T.load_task(spark, sf, "mc")
    job = JOB.train_job(spark, t.select("id", "y", "o_totalprice", "part"), spec, get_trainer("linear", maxIter=5), scratch_path(spark, "job"), "mc")
    probs = spark.read.parquet(job.path("test"))
    classes = [c for c in probs.columns if c != "id"]
    best = F.greatest(*[F.col(f"`{c}`") for c in classes])
    chosen = F.coalesce(*[F.when(F.col("y") == c, F.col(f"`{c}`")) for c in classes])
    total = sum((F.col(f"`{c}`") for c in classes), F.lit(0.0))
    sub = spark.read.parquet(job.path("submission"))
    return probs.join(sub, "id").select("id", (F.abs(total - 1) < 1e-9).alias("sums_to_one"), (chosen == best).alias("is_best"))


@query("stack_of_stored_runs", f"""WITH {S.folded('syn')}
SELECT 'stack_1' AS exp_id, 'StratifiedKFold_5' AS cv_strategy, id, fold, true AS in_range FROM f""")
def q_stack_of_stored_runs(spark, sf):
    """Two stored runs and a stack of them: folds by the runs' logged regime from the stored split, the
    stack stored like a run."""
    t, spec = _syn_model_task(spark, sf)
    t, spec, store = materialize(t.drop("ts", "value")), _replace(spec, te_cols=(), drop_cols=("user_id",)), scratch_path(spark, "store")
    jobs = JOB.sweep(spark, t, spec, {"a": get_trainer("linear"), "b": get_trainer("rf", numTrees=5)}, store)
    logs = jobs["a"].path("logs")
    oof, test = JOB.members_of(spark, store, ["a", "b"], "y")
    train, ids = T.train_rows(t).select("id", "y", F.lit(None).cast("int").alias("fold")), T.test_rows(t).select("id")
    stack = ST.stack_job(spark, oof, test, train, ids, ["a", "b"], spec, raw_logs=RU.read_raw_logs(spark, logs), split_store=f"{store}/splits")
    JOB.record_stack(spark, stack, store, "stack_1")
    kept = RU.read_raw_logs(spark, logs).where("exp_id = 'stack_1'").select("exp_id", "cv_strategy")
    split = IG.get_or_create_split(spark, T.train_rows(t), spec, f"{store}/splits")
    rows = spark.read.parquet(f"{store}/oof/stack_1").join(split, "id").crossJoin(F.broadcast(kept))  # one record
    return rows.select("exp_id", "cv_strategy", "id", "fold", F.col("oof").between(0, 1).alias("in_range"))


# ---------------------------------------------------------------- diagnostics (described procedures)
from foldwise.operators import diagnostics as DG  # noqa: E402


@query("freq_encoding", f"""WITH t AS ({S.TASKS['bin']}),
c AS (SELECT user_id, count(*) AS user_id_freq FROM t WHERE part IN ('train', 'test') AND user_id IS NOT NULL GROUP BY user_id)
SELECT t.id, c.user_id_freq FROM t LEFT JOIN c ON t.user_id = c.user_id WHERE t.part = 'train'""")
def q_freq_encoding(spark, sf):
    t = T.bin_task(spark, sf)
    fr = DG.frequency_encoding([T.train_rows(t), T.test_rows(t)], "user_id")
    return T.train_rows(t).join(fr, "user_id", "left").select("id", "user_id_freq")


@query("group_overlap", f"""WITH {S.folded('bin')}
SELECT 'StratifiedKFold' AS strategy, count(*) AS n_groups FROM (SELECT user_id FROM f GROUP BY user_id HAVING count(DISTINCT fold) > 1)""")
def q_group_overlap(spark, sf):
    f, _, _ = _folded(spark, sf, "bin")
    g, _, _ = _folded(spark, sf, "grp")
    assert DG.group_overlap(g, ["user_id"]).limit(1).count() == 0
    return DG.group_overlap(f, ["user_id"]).agg(F.lit("StratifiedKFold").alias("strategy"),
                                                 F.count(F.lit(1)).alias("n_groups"))


@query("residual_corr", f"""WITH {SYN_OOF},
w AS (SELECT id, any_value(y) - max(p) FILTER (WHERE member = 'p1') AS p1, any_value(y) - max(p) FILTER (WHERE member = 'p2') AS p2,
  any_value(y) - max(p) FILTER (WHERE member = 'p3') AS p3 FROM mo GROUP BY id)
{_corr_sql(['p1', 'p2', 'p3'])}""")
def q_residual_corr(spark, sf):
    mo, _, _ = _syn_oof(spark, sf, ties=False)
    res = mo.select("member", "id", (F.col("y") - F.col("p")).alias("r"))
    return MM.correlation(MM.member_matrix(res, MEMBERS3, p="r"), MEMBERS3)


@query("seed_average", f"""WITH t AS ({S.TASKS['syn']}), s AS (SELECT range AS seed FROM range(3)),
sp AS (SELECT t.id, 0.5 * {S.U('t.id', 'a')} + 0.5 * (('0x' || substring(md5(CAST(t.id AS VARCHAR) || ':' || CAST(s.seed AS VARCHAR) || ':seed'), 1, 8))::BIGINT / 4294967296.0) AS p
       FROM t CROSS JOIN s WHERE t.part = 'train')
SELECT id, round(avg(p), 6) AS p FROM sp GROUP BY id""")
def q_seed_average(spark, sf):
    t = T.train_rows(T.syn_task(spark, sf)).select("id").withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(2))))
    key = F.concat(F.col("id").cast("string"), F.lit(":"), F.col("seed").cast("string"))
    sp = t.select("id", (0.5 * uniform("id", "a") + 0.5 * uniform(key, "seed")).alias("p"))
    return OOF.mean_prediction(sp).select("id", r6("p").alias("p"))


@query("oof_lb_gap", f"""WITH {RUNS}
SELECT exp_id, round(cv_mean - lb_score, 6) AS gap FROM logs WHERE lb_score IS NOT NULL""")
def q_oof_lb_gap(spark, sf):
    raw, _ = EX.load_runs(spark, sf)
    return raw.where(F.col("lb_score").isNotNull()).select("exp_id", r6(F.col("cv_mean") - F.col("lb_score")).alias("gap"))


@query("verdict", f"""WITH {RUNS},
e AS (SELECT exp_id, unnest(cv_scores) AS s FROM logs WHERE exp_id = 'exp_001'),
a AS (SELECT 2 * stddev_samp(s) / sqrt(count(s)) AS two_se FROM e),
b AS (SELECT cv_mean AS a_mean FROM logs WHERE exp_id = 'exp_001')
SELECT exp_id, round(cv_mean - a_mean, 6) AS delta,
  CASE WHEN cv_mean IS NULL THEN 'no score' WHEN abs(cv_mean - a_mean) < two_se THEN 'inconclusive'
       WHEN cv_mean - a_mean > 0 THEN 'better' ELSE 'worse' END AS verdict
FROM logs, a, b WHERE exp_id <> 'exp_001'""")
def q_verdict(spark, sf):
    raw, _ = EX.load_runs(spark, sf)
    v = DG.verdicts(RU.fold_noise(raw), "exp_001", raw)
    return v.select("exp_id", r6("delta").alias("delta"), "verdict")


@query("drift_psi", f"""WITH t AS ({S.TASKS['bin']}),
rg AS (SELECT min(value) AS lo, max(value) AS hi FROM t WHERE part IN ('train', 'test')),
b AS (SELECT part, CASE WHEN hi = lo THEN 0 ELSE least(floor((value - lo) / (hi - lo) * 10), 9) END AS b FROM t, rg
      WHERE value IS NOT NULL AND part IN ('train', 'test')),
c AS (SELECT b, count(*) FILTER (WHERE part = 'train') AS nb, count(*) FILTER (WHERE part = 'test') AS no FROM b GROUP BY b),
tt AS (SELECT sum(nb) AS tb, sum(no) AS tn FROM c)
SELECT round(sum((greatest(nb / tb, 1e-4) - greatest(no / tn, 1e-4)) * ln(greatest(nb / tb, 1e-4) / greatest(no / tn, 1e-4))), 6) AS psi FROM c, tt""")
def q_drift_psi(spark, sf):
    t = T.bin_task(spark, sf).where(F.col("part").isin("train", "test"))
    return DG.psi(t, "value", "part", "train", "test").select(r6("psi").alias("psi"))


@query("adversarial_auc", f"""WITH t AS (SELECT id, CAST(part = 'test' AS INTEGER) AS y FROM ({S.TASKS['bin']}) WHERE part IN ('train', 'test')),
f AS (SELECT *, {S.strat_fold(5, 42, 'y')} AS fold FROM t)
SELECT fold, count(*) AS n, true AS no_drift FROM f GROUP BY fold""")
def q_adversarial_auc(spark, sf):
    """Train/test drift by adversarial validation: OOF AUC of a classifier for is_test."""
    t = T.bin_task(spark, sf).where(F.col("part").isin("train", "test"))
    adv = t.select("id", (F.col("part") == "test").cast("int").alias("y"), "value", "user_id",
                   F.lit("train").alias("part"))
    spec = _replace(T.SPECS["syn"])
    run = OOF.run_oof(spark, adv, spec, get_trainer("rf", numTrees=20), ["value", "user_id"])
    n = run.oof.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    return run.fold_scores.join(n, "fold").select("fold", "n", F.col("score").between(0.35, 0.65).alias("no_drift"))


@query("masking_invariance", f"""WITH t AS ({S.TASKS['bin']})
SELECT count(*) AS n_before_cut, 0 AS n_changed FROM t
WHERE ts < (SELECT arg_min(ts, id) FROM t WHERE id >= (SELECT floor(avg(id)) FROM t))""")
def q_masking_invariance(spark, sf):
    t = T.bin_task(spark, sf)
    mean = t.agg(F.floor(F.avg("id")).alias("c")).first()["c"]
    cut_ts = t.where(F.col("id") >= mean).agg(F.min_by("ts", "id").alias("ts")).first()["ts"]  # the cut: one event's time
    cols = [f"value_past_{a}" for a in ("mean", "std", "max", "min", "sum")]
    full = past_features(t, "value", ["user_id"], "ts", exact_scale=6)
    trunc = past_features(t.where(F.col("ts") < F.lit(cut_ts)), "value", ["user_id"], "ts", exact_scale=6)
    diff = DG.masking_invariance(full, trunc, "id", cols)
    n = t.where(F.col("ts") < F.lit(cut_ts)).agg(F.count(F.lit(1)).alias("n_before_cut"))
    return with_scalars(n, diff.agg(F.count(F.lit(1)).cast("int").alias("n_changed")))


@query("stack_add", f"""WITH {SYN_OOF},
w3 AS (SELECT id, any_value(y) AS y, avg(p) AS p FROM mo WHERE member IN ('p1', 'p2', 'p3') GROUP BY id),
w2 AS (SELECT id, any_value(y) AS y, avg(p) AS p FROM mo WHERE member IN ('p1', 'p2') GROUP BY id)
SELECT 'p3' AS candidate, round((SELECT auc FROM {S.auc_sql('w3', '')}) - (SELECT auc FROM {S.auc_sql('w2', '')}), 6) AS delta_auc""")
def q_stack_add(spark, sf):
    mo, _, _ = _syn_oof(spark, sf, ties=False)
    with_c = M.auc(BL.blend_equal(mo).join(mo.select("id", "y").distinct(), "id"), []).withColumnRenamed("auc", "a3")
    without = M.auc(BL.blend_equal(mo.where(F.col("member") != "p3")).join(mo.select("id", "y").distinct(), "id"), [])
    return with_scalars(with_c, without).select(F.lit("p3").alias("candidate"), r6(F.col("a3") - F.col("auc")).alias("delta_auc"))


@query("fold_input_check", f"""WITH {S.folded('syn')}, ks AS (SELECT CAST(range AS INTEGER) AS k FROM range(5)),
r AS (SELECT k, 'fit' AS role FROM f JOIN ks ON f.fold <> k UNION ALL SELECT fold, 'valid' FROM f
      UNION ALL SELECT k, 'predict' FROM t CROSS JOIN ks WHERE part = 'test')
SELECT k AS fold, role, count(*) AS n, false AS changed FROM r GROUP BY k, role""")
def q_fold_input_check(spark, sf):
    """Input-equivalence gate: fingerprints of every model input (fold x role) of two
    runs of the same recipe; the diff must be empty."""
    t, spec = _syn_model_task(spark, sf)
    a = OOF.run_oof(spark, t, spec, get_trainer("linear"), ["value", "s_a", "s_n"], capture_inputs=True)
    b = OOF.run_oof(spark, t, spec, get_trainer("linear"), ["value", "s_a", "s_n"], capture_inputs=True)
    diff = IG.fingerprint_diff(a.input_fingerprints, b.input_fingerprints, ["fold", "role"])
    return a.input_fingerprints.join(diff.select("fold", "role", F.lit(True).alias("changed")), ["fold", "role"], "left") \
        .select("fold", "role", "n", F.coalesce("changed", F.lit(False)).alias("changed"))
