"""Blend fits: KKT on the simplex, logistic gradient, OLS normal equations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from foldwise.operators import solvers as SV
from foldwise.operators.members import correlation, member_matrix
from foldwise.sources import members as MB
from foldwise.sources import tasks as T


def _syn(spark, names=("p1", "p2", "p3")):
    t = T.syn_task(spark, SF_MID)
    m = MB.binary_members(t, names=names)
    X = member_matrix(m, list(names)).join(t.select("id", "y"), "id").withColumn("fold", F.lit(0))
    return X


def test_convex_logloss_matches_reference_weights(spark):
    X = _syn(spark).cache()
    W, loss, grad, passes = SV.convex_logloss_fit(X, ["p1", "p2", "p3"], "y", "fold", 1)
    w = W[1]  # all rows
    assert SV.kkt_residual(w, grad[1]) < 1e-7
    assert np.allclose(w, [0.49793, 0.50207, 0.0], atol=2e-4)
    assert abs(loss[1] - 0.508142) < 2e-5


def test_convex_logloss_vertex_case(spark):
    X = _syn(spark, ("p4", "p2", "p3")).cache()
    W, loss, grad, passes = SV.convex_logloss_fit(X, ["p4", "p2", "p3"], "y", "fold", 1)
    assert np.allclose(W[1], [1.0, 0.0, 0.0], atol=1e-6)
    assert SV.kkt_residual(W[1], grad[1]) < 1e-7


def test_convex_mse_kkt(spark):
    X = _syn(spark).cache()
    S = SV.fold_moments(X, ["p1", "p2", "p3"], "y", "fold", 1)
    w = SV.mse_simplex_fit(S[1], 3)
    n, _, _, sxy, G, _ = SV.unpack_moments(S[1], 3)
    grad = (2 * G @ w - 2 * sxy) / n
    assert SV.kkt_residual(w, grad) < 1e-9
    assert np.allclose(w, [0.49639, 0.50361, 0.0], atol=2e-4)


def test_logistic_gradient_is_zero(spark):
    X = _syn(spark).cache()
    B, grad, passes = SV.logistic_fit(X, ["p1", "p2", "p3"], "y", "fold", 1)
    assert np.max(np.abs(grad[1])) < 1e-6


def test_ols_normal_equations(spark):
    X = _syn(spark).cache()
    S = SV.fold_moments(X, ["p1", "p2", "p3"], "y", "fold", 1)
    b = SV.ols_fit(S[1], 3)
    n, sy, sx, sxy, G, _ = SV.unpack_moments(S[1], 3)
    A = np.block([[np.array([[n]]), sx[None, :]], [sx[:, None], G]])
    assert np.allclose(A @ b, np.concatenate([[sy], sxy]), rtol=1e-9)


def test_moments_exclude_own_fold(spark):
    df = spark.createDataFrame([(i % 3, float(i), 1.0) for i in range(30)], "fold int, x double, y double")
    S = SV.fold_moments(df, ["x"], "y", "fold", 3)
    total = sum(range(30))
    for q in range(3):
        n, sy, sx, sxy, G, syy = SV.unpack_moments(S[q], 1)
        assert (n, sy, syy) == (20, 20, 20)
        assert sx[0] == sxy[0] == total - sum(i for i in range(30) if i % 3 == q)
        assert G[0, 0] == sum(i * i for i in range(30) if i % 3 != q)
    assert SV.unpack_moments(S[3], 1)[2][0] == total


def _wide_members(spark, members=30, folds=10, rows=4000, seed=8):
    rnd = np.random.default_rng(seed)
    signal = rnd.normal(size=rows)
    x = 1 / (1 + np.exp(-(signal[:, None] + rnd.normal(size=(rows, members)) * np.linspace(0.5, 3, members))))
    y = (signal + 0.5 * rnd.normal(size=rows) > 0).astype(int)
    names = [f"m{i}" for i in range(members)]
    fold = np.arange(rows) % folds
    table = [(int(i), int(fold[i]), int(y[i]), *map(float, x[i])) for i in range(rows)]
    df = spark.createDataFrame(table, "id long, fold int, y int, " + ", ".join(f"{n} double" for n in names)).repartition(7)
    return df, names, x, y, fold


def test_thirty_members_and_ten_folds(spark):
    """Weights of each problem against its own rows; a pass plans one array, whatever M and K are."""
    df, names, x, y, fold = _wide_members(spark)
    S = SV.fold_moments(df, names, "y", "fold", 10)
    B, grad, _ = SV.logistic_fit(df, names, "y", "fold", 10)
    W, loss, kkt, _ = SV.convex_logloss_fit(df, names, "y", "fold", 10)
    for q in (0, 7, 10):
        use = fold != q
        a = np.concatenate([np.ones((use.sum(), 1)), y[use, None], x[use]], axis=1)
        assert np.allclose(S[q], a.T @ a, rtol=1e-9)
        f = np.concatenate([np.ones((use.sum(), 1)), x[use]], axis=1)
        r = 1 / (1 + np.exp(-(f @ B[q]))) - y[use]
        g = f.T @ r + np.concatenate([[0.0], B[q][1:]])
        assert np.max(np.abs(g)) < 1e-6
        p = x[use] @ W[q]
        g = -(x[use] * (y[use] / p - (1 - y[use]) / (1 - p))[:, None]).mean(axis=0)
        assert SV.kkt_residual(W[q], g) < 1e-7
        assert abs(loss[q] + np.mean(y[use] * np.log(p) + (1 - y[use]) * np.log(1 - p))) < 1e-9


def test_many_tasks_are_merged_by_tasks(spark):
    df, names, x, y, fold = _wide_members(spark, 4, 3, 600)
    few = SV.fold_moments(df, names, "y", "fold", 3)
    many = SV.fold_moments(df.repartition(SV.DIRECT + 6), names, "y", "fold", 3)
    assert np.allclose(few, many, rtol=1e-12)


def test_missing_predictions_are_an_error(spark):
    df = spark.createDataFrame([(0, 0, 0.5), (1, 1, None), (0, 1, 0.3)], "fold int, y int, a double")
    with pytest.raises(ValueError, match="1 rows"):
        SV.fold_moments(df, ["a"], "y", "fold", 2)


def _classes(spark, members, classes, rows, folds, seed):
    rnd = np.random.default_rng(seed)
    t = rnd.integers(0, classes, rows)
    p = rnd.random((rows, members, classes)) + np.eye(classes)[t][:, None, :] * np.linspace(0.8, 0, members)[:, None]
    x = (p / p.sum(axis=2, keepdims=True)).reshape(rows, -1)
    fold = np.arange(rows) % folds
    df = spark.createDataFrame([(int(i), int(fold[i]), int(t[i]), x[i].tolist()) for i in range(rows)],
                               "id long, fold int, code int, features array<double>").repartition(5)
    return df, x, t, fold


@pytest.mark.parametrize("members, classes, newton", [(3, 4, True), (6, 9, False)])
def test_multinomial_optimum_of_every_fold(spark, members, classes, newton):
    """The gradient of every problem is zero on its own rows, and a step aside costs; both solvers."""
    df, x, t, fold = _classes(spark, members, classes, 1500, 4, 21)
    d = members * classes
    assert (classes * (d + 1) <= SV.NEWTON_MOST) == newton
    B, obj, _, passes = SV.multinomial_fit(df, "features", d, "code", classes, "fold", 4)

    def objective(b, use):
        z = x[use] @ b[:, 1:].T + b[:, 0]
        top = z.max(axis=1, keepdims=True)
        return float(np.sum(top[:, 0] + np.log(np.exp(z - top).sum(axis=1)) - z[np.arange(use.sum()), t[use]])) + 0.5 * np.sum(b[:, 1:] ** 2)

    for q in range(5):
        use = fold != q
        f = np.concatenate([np.ones((use.sum(), 1)), x[use]], axis=1)
        g = (SV._softmax(f @ B[q].T) - np.eye(classes)[t[use]]).T @ f
        g[:, 1:] += B[q][:, 1:]
        best = objective(B[q], use)
        assert np.max(np.abs(g)) < 1e-5 * max(1.0, best) and abs(best - obj[q]) < 1e-6 * best
        rnd = np.random.default_rng(q)
        assert all(objective(B[q] + 0.05 * rnd.normal(size=B[q].shape), use) > best for _ in range(5))
    out = SV.multinomial_predict(df, B, "features", ["id", "fold"], "fold").collect()
    for r in out[:50]:
        want = SV._softmax(x[r.id] @ B[r.fold][:, 1:].T + B[r.fold][:, 0])
        assert np.allclose(r.probs, want, atol=1e-12)


def test_multinomial_that_runs_out_of_passes(spark):
    df, *_ = _classes(spark, 3, 4, 400, 3, 22)
    with pytest.raises(SV.NotConverged):
        SV.multinomial_fit(df, "features", 12, "code", 4, "fold", 3, max_passes=2)


def test_constant_member_correlation_is_null(spark):
    X = _syn(spark).withColumn("c", F.lit(0.5))
    rows = {(r["member_a"], r["member_b"]): r["corr"] for r in correlation(X, ["p1", "c"]).collect()}
    assert rows[("p1", "c")] is None and rows[("p1", "p1")] == 1.0


def test_simplex_projection():
    w = SV.project_simplex(np.array([0.2, 2.0, -1.0]))
    assert abs(w.sum() - 1) < 1e-12 and (w >= 0).all()
