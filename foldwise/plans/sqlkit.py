"""SQL text helpers for the DuckDB oracle queries (same definitions as Spark)."""

from __future__ import annotations


def U(key: str, tag: str) -> str:
    """SQL twin of ``functions.scalar.uniform``."""
    return f"(('0x' || substring(md5(CAST({key} AS VARCHAR) || ':{tag}'), 1, 8))::BIGINT / 4294967296.0)"


def PART(key: str) -> str:
    u = U(key, "part")
    return f"(CASE WHEN {u} >= 0.8 THEN 'test' WHEN {u} >= 0.7 THEN 'source' ELSE 'train' END)"


def H(key: str, *salt) -> str:
    """md5 of ``<key>:<salt>...``."""
    s = f"CAST({key} AS VARCHAR)"
    for x in salt:
        s += f" || ':' || CAST({x} AS VARCHAR)"
    return f"md5({s})"


TASKS = {
    "bin": f"""SELECT event_id AS id, CAST(event_type = 'purchase' AS INTEGER) AS y, user_id, value, ts,
        {PART('event_id')} AS part FROM events""",
    "syn": f"""SELECT event_id AS id, CAST(0.7 * {U('event_id', 'a')} + 0.3 * {U('event_id', 'n')} > 0.5 AS INTEGER) AS y,
        user_id, value, ts, {PART('event_id')} AS part FROM events""",
    "reg": f"""SELECT o_orderkey AS id, o_totalprice AS y, o_custkey, o_orderdate, o_orderstatus,
        {PART('o_orderkey')} AS part FROM orders""",
    "mc": f"""SELECT o_orderkey AS id, o_orderpriority AS y, o_orderstatus, o_totalprice,
        {PART('o_orderkey')} AS part FROM orders""",
    "imb": f"""SELECT l.doc_id AS id, l.toxic AS y, d.lang, d.source, d.n_chars, {PART('l.doc_id')} AS part
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "vec": f"""SELECT vec_id AS id, label AS y, {PART('vec_id')} AS part FROM embeddings""",
}
TASKS["grp"] = TASKS["bin"]


def strat_fold(n: int = 5, seed: int = 42, strata: str | None = "y", part: str = "") -> str:
    order = (f"{strata}, " if strata else "") + f"{H('id', seed)}, id"
    p = f"PARTITION BY {part} " if part else ""
    return f"CAST((row_number() OVER ({p}ORDER BY {order}) - 1) % {n} AS INTEGER)"


def folded(task: str, n: int = 5, seed: int = 42, strategy: str = "StratifiedKFold") -> str:
    """CTE text: ``t`` = task rows, ``f`` = train rows with ``fold``."""
    if strategy == "GroupKFold":
        return f"""t AS ({TASKS[task]}),
tr AS (SELECT * FROM t WHERE part = 'train'),
gs AS (SELECT user_id, count(*) AS gn FROM tr GROUP BY user_id),
gr AS (SELECT user_id, CAST((row_number() OVER (ORDER BY gn DESC, md5(coalesce(CAST(user_id AS VARCHAR), '')),
        user_id NULLS FIRST) - 1) % {n} AS INTEGER) AS fold FROM gs),
f AS (SELECT tr.*, gr.fold FROM tr JOIN gr ON tr.user_id IS NOT DISTINCT FROM gr.user_id)"""
    strata = "y" if strategy == "StratifiedKFold" else None
    return f"""t AS ({TASKS[task]}),
f AS (SELECT *, {strat_fold(n, seed, strata)} AS fold FROM t WHERE part = 'train')"""


def te_ctes(task: str, col: str, strategy: str, inner: str, n: int = 5, n_inner: int = 5,
            smoothing: float = 20.0, seed: int = 42) -> str:
    """CTEs of nested target encoding: f, L (row x outer k, inner j), pr, cell, enc, map."""
    if inner == "group":
        jdef = f"""Lg AS (SELECT k, user_id, count(*) AS gn FROM L GROUP BY k, user_id),
Lgr AS (SELECT k, user_id, CAST((row_number() OVER (PARTITION BY k ORDER BY gn DESC,
        md5(coalesce(CAST(user_id AS VARCHAR), '')), user_id NULLS FIRST) - 1) % {n_inner} AS INTEGER) AS j FROM Lg),
Lj AS (SELECT L.*, Lgr.j FROM L JOIN Lgr ON L.k = Lgr.k AND L.user_id IS NOT DISTINCT FROM Lgr.user_id)"""
    else:
        strata = "y" if inner == "strat" else None
        jdef = f"""Lj AS (SELECT *, {strat_fold(n_inner, seed, strata, part='k').replace(H('id', seed), H('id', seed, 'k'))} AS j FROM L)"""
    sm = float(smoothing)
    return f"""{folded(task, n, seed, strategy)},
L AS (SELECT f.*, CAST(r.range AS INTEGER) AS k FROM f CROSS JOIN range({n}) r WHERE r.range <> f.fold),
{jdef},
pr AS (SELECT k, avg(CAST(y AS DOUBLE)) AS prior FROM Lj GROUP BY k),
cell AS (SELECT k, {col}, j, sum(CAST(y AS DOUBLE)) AS s, count(*) AS n FROM Lj WHERE {col} IS NOT NULL GROUP BY k, {col}, j),
enc AS (SELECT a.k, a.{col}, a.j, coalesce(sum(b.s), 0) AS S, coalesce(sum(b.n), 0) AS N
        FROM cell a LEFT JOIN cell b ON a.k = b.k AND a.{col} = b.{col} AND a.j <> b.j GROUP BY a.k, a.{col}, a.j),
map AS (SELECT cell.k, cell.{col}, (sum(cell.s) + any_value(pr.prior) * {sm}) / (sum(cell.n) + {sm}) AS enc,
        sum(cell.n) AS n FROM cell JOIN pr ON cell.k = pr.k GROUP BY cell.k, cell.{col}),
te AS (SELECT Lj.id, Lj.fold, Lj.k, CASE WHEN enc.N > 0 THEN (enc.S + pr.prior * {sm}) / (enc.N + {sm}) ELSE pr.prior END AS te
       FROM Lj JOIN pr ON Lj.k = pr.k LEFT JOIN enc ON Lj.k = enc.k AND Lj.{col} = enc.{col} AND Lj.j = enc.j)"""


BIN_MEMBERS = {
    "p1": f"0.5 * {U('id', 'a')} + 0.5 * {U('id', 'm1')}",
    "p2": f"0.5 * {U('id', 'a')} + 0.5 * {U('id', 'm2')}",
    "p3": f"{U('id', 'm3')}",
    "p4": f"0.8 * {U('id', 'a')} + 0.2 * {U('id', 'm1')}",
}


def bin_members(src: str = "t", names=("p1", "p2", "p3"), ties: bool = False) -> str:
    parts = [f"SELECT '{n}' AS member, id, {BIN_MEMBERS[n]} AS p FROM {src}" for n in names]
    if ties:
        parts.append(f"SELECT 'p1r' AS member, id, round({BIN_MEMBERS['p1']}, 2) AS p FROM {src}")
    return " UNION ALL ".join(parts)


def reg_members(src: str = "t") -> str:
    return " UNION ALL ".join([
        f"SELECT 'r1' AS member, id, y * (0.9 + 0.2 * {U('id', 'm1')}) AS p FROM {src}",
        f"SELECT 'r2' AS member, id, y * (0.9 + 0.2 * {U('id', 'm2')}) AS p FROM {src}",
        f"SELECT 'r3' AS member, id, y * (0.5 + {U('id', 'm3')}) AS p FROM {src}",
    ])


MC_BOOST = {"c1": 0.6, "c2": 0.4, "c3": 0.0}


def mc_ctes() -> str:
    """CTEs: t (mc task), lm (label map of train labels), tc (coded rows), mm (members)."""
    parts = []
    for name, b in MC_BOOST.items():
        raw = (f"list_transform(range((SELECT count(*) FROM lm)), lambda k: "
               f"{U(chr(40) + 'CAST(id AS VARCHAR) || :' + chr(41), name)})")
        raw = (f"list_transform(range((SELECT count(*) FROM lm)), lambda k: "
               f"(('0x' || substring(md5(CAST(id AS VARCHAR) || ':' || CAST(k AS VARCHAR) || ':{name}'), 1, 8))::BIGINT"
               f" / 4294967296.0) + CASE WHEN k = code THEN {b} ELSE 0.0 END)")
        parts.append(f"SELECT '{name}' AS member, id, {raw} AS raw FROM tc")
    return f"""t AS ({TASKS['mc']}),
lm AS (SELECT y AS label, CAST(row_number() OVER (ORDER BY y) - 1 AS INTEGER) AS code
       FROM (SELECT DISTINCT y FROM t WHERE part = 'train')),
tc AS (SELECT t.*, lm.code FROM t JOIN lm ON t.y = lm.label),
mr AS ({' UNION ALL '.join(parts)}),
mm AS (SELECT member, id, list_transform(raw, lambda x: x / list_sum(raw)) AS probs FROM mr)"""


def auc_sql(src: str, keys: str) -> str:
    """AUC per keys over ``src`` (keys..., y, p)."""
    k = keys + ", " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    grp = f"GROUP BY {keys}" if keys else ""
    return f"""(WITH g AS (SELECT {k}p, sum(y) AS pos, sum(1 - y) AS neg FROM {src} GROUP BY {k}p),
r AS (SELECT *, coalesce(sum(neg) OVER ({part}ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM g)
SELECT {k}CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (nb + neg / 2.0)) / (sum(pos) * sum(neg)) END AS auc
FROM r {grp})"""


RUN_PLAN_SQL_COLS = "exp_id, model, member, n_folds, folds_run, ts, notes, fb"


def runs_ctes(iterations: bool = False) -> str:
    """CTEs: fs (exp_id, fold, score), rp (run plan), logs (flat raw), led (ledger); with
    ``iterations`` fs has best_iter and rec the list best_iters."""
    from foldwise.plans.experiments import ITER_CAP, LEDGER_PLAN, RUN_PLAN

    def q(x):
        return "NULL" if x is None else ("'" + str(x).replace("'", "''") + "'" if isinstance(x, str) else str(x))
    rp = ", ".join("(" + ", ".join(q(v) for v in r) + ")" for r in RUN_PLAN)
    lp = ", ".join("(" + ", ".join(q(v) if not isinstance(v, bool) else str(v).upper() for v in r) + ")"
                   for r in LEDGER_PLAN)
    mem = " UNION ALL ".join(
        [f"SELECT '{n}' AS member, id, {BIN_MEMBERS[n]} AS p FROM {{src}}" for n in ("p1", "p2", "p3", "p4")]
        + [f"SELECT 'equal' AS member, id, ({BIN_MEMBERS['p1']} + {BIN_MEMBERS['p2']}) / 2 AS p FROM {{src}}"])
    it = (f""",
         CASE WHEN NOT starts_with(rp.model, 'stack') THEN CAST(least(floor(sc.auc * 1200), {ITER_CAP - 1}) AS INTEGER) END AS best_iter"""
          if iterations else "")
    its = " list(fs.best_iter ORDER BY fs.fold) AS best_iters," if iterations else ""
    return f"""t AS ({TASKS['syn']}),
tr AS (SELECT * FROM t WHERE part = 'train'),
f5 AS (SELECT id, y, {strat_fold(5)} AS fold, 5 AS n_folds FROM tr),
f7 AS (SELECT id, y, {strat_fold(7)} AS fold, 7 AS n_folds FROM tr),
ff AS (SELECT * FROM f5 UNION ALL SELECT * FROM f7),
ml AS ({mem.format(src='tr')}),
mo AS (SELECT ml.member, ff.n_folds, ff.fold, ff.y, ml.p FROM ml JOIN ff ON ml.id = ff.id),
pf AS (SELECT * FROM {auc_sql("(SELECT * FROM mo WHERE member <> 'equal')", 'member, n_folds, fold')}),
pe AS (SELECT member, n_folds, 0 AS fold, auc FROM {auc_sql("(SELECT * FROM mo WHERE member = 'equal')", 'member, n_folds')}),
sc AS (SELECT * FROM pf UNION ALL SELECT * FROM pe),
rp AS (SELECT * FROM (VALUES {rp}) v({RUN_PLAN_SQL_COLS})),
fs AS (SELECT rp.exp_id, sc.fold, sc.auc AS score{it}
       FROM rp JOIN sc ON rp.member = sc.member AND rp.n_folds = sc.n_folds
       WHERE rp.folds_run IS NULL OR sc.fold < rp.folds_run),
rec AS (SELECT rp.exp_id, rp.model, rp.ts AS timestamp, rp.notes, rp.fb AS feature_builder,
          'StratifiedKFold_' || rp.n_folds || CASE WHEN rp.folds_run IS NOT NULL THEN '_partial' || rp.folds_run ELSE '' END AS cv_strategy,
          list(round(fs.score, 6) ORDER BY fs.fold) AS cv_scores,{its}
          round(avg(fs.score), 6) AS cv_mean, round(stddev_pop(fs.score), 6) AS cv_std, 2 AS n_feat
        FROM rp JOIN fs ON rp.exp_id = fs.exp_id
        GROUP BY rp.exp_id, rp.model, rp.ts, rp.notes, rp.fb, rp.n_folds, rp.folds_run),
te AS (SELECT id, y, CASE WHEN {U('id', 'pub')} < 0.5 THEN 'public' ELSE 'private' END AS half FROM t WHERE part = 'test'),
tm AS (SELECT ml.member, te.half, te.y, ml.p FROM ({mem.format(src='te')}) ml JOIN te ON ml.id = te.id),
th AS (SELECT * FROM {auc_sql('tm', 'member, half')}),
lp AS (SELECT * FROM (VALUES {lp}) v(timestamp, exp_id, message, member, with_private)),
led AS (SELECT lp.timestamp, lp.exp_id, lp.message,
          round((SELECT auc FROM th WHERE th.member = lp.member AND half = 'public'), 6) AS lb_public,
          CASE WHEN with_private THEN round((SELECT auc FROM th WHERE th.member = lp.member AND half = 'private'), 6) END AS lb_private
        FROM lp),
lat AS (SELECT exp_id, coalesce(lb_private, lb_public) AS lb FROM
        (SELECT *, row_number() OVER (PARTITION BY exp_id ORDER BY timestamp DESC, message DESC) AS rn FROM led) WHERE rn = 1),
logs AS (SELECT rec.*, lat.lb AS lb_score FROM rec LEFT JOIN lat ON rec.exp_id = lat.exp_id)"""
