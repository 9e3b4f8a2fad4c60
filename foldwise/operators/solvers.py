"""Fold-parallel fitting of small meta-models.

Problem q in 0..K-1 is "fit on the rows with fold != q", problem K is "fit
on all rows". A pass reads the rows once: every task adds up the statistics
of all problems over its Arrow batches as matrix products in one array, and
the arrays of the tasks are added in a few merging tasks. What a pass plans
is two columns however many members there are, and what it shuffles is one
array per task. The driver holds the sum, K x (M^2) numbers, and solves
M-sized systems.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.functions.scalar import BLEND_EPS
from foldwise.session import materialize

MERGE_TASKS = 16    # tasks that add up the arrays of more tasks than ``DIRECT``
DIRECT = 64         # so many arrays are added on the driver


def block_sums(df: DataFrame, cols: Sequence[str], kernel: Callable[[np.ndarray], np.ndarray], width: int,
               vector: str | None = None, partitions: int | None = None) -> np.ndarray:
    """Sum of ``kernel`` over blocks of rows: an array of ``width`` numbers.

    ``kernel`` gets a block as a float matrix, one column per name in ``cols`` and then those of
    the array column ``vector``. A null or NaN is an error: a fit would leave the row out silently.
    """
    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)],
                     *([F.col(vector).cast("array<double>").alias("v")] if vector else []))
    if partitions is None:
        partitions = rows.rdd.getNumPartitions()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width + 1)
        for batch in batches:
            n = batch.num_rows
            x = [batch.column(i).to_numpy(zero_copy_only=False).reshape(n, 1) for i in range(len(cols))]
            if vector:
                if batch.column(len(cols)).null_count:
                    total[width] += batch.column(len(cols)).null_count
                    continue
                x.append(batch.column(len(cols)).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0)))
            x = np.concatenate(x, axis=1)
            bad = np.isnan(x).any(axis=1)
            total[width] += bad.sum()
            if n and not bad.any():
                total[:width] += kernel(x)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["s"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width + 1)
        for batch in batches:
            total += batch.column(0).flatten().to_numpy().reshape(-1, width + 1).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["s"])

    sums = rows.mapInArrow(partial, "s array<double>")
    if partitions > DIRECT:
        sums = sums.repartition(MERGE_TASKS).mapInArrow(merge, "s array<double>")
    total = np.array([r.s for r in sums.collect()]).reshape(-1, width + 1).sum(axis=0)
    if total[width]:
        raise ValueError(f"{int(total[width])} rows have a null or NaN prediction or target")
    return total[:width]


def _chosen(fold: np.ndarray, n_folds: int) -> np.ndarray:
    """(rows, K+1): 1 where the row trains the problem."""
    return np.concatenate([fold[:, None] != np.arange(n_folds), np.ones((len(fold), 1), dtype=bool)], axis=1).astype(np.float64)


# ------------------------------------------------------------------ simplex QP
def project_simplex(v: np.ndarray) -> np.ndarray:
    """Euclidean projection onto {w >= 0, sum w = 1}."""
    u = np.sort(v)[::-1]
    css = np.cumsum(u)
    k = np.arange(1, len(v) + 1)
    cond = u - (css - 1) / k > 0
    r = k[cond][-1]
    tau = (css[r - 1] - 1) / r
    return np.maximum(v - tau, 0.0)


def simplex_qp(H: np.ndarray, g: np.ndarray, w0: np.ndarray | None = None, iters: int = 20000,
               tol: float = 1e-13) -> np.ndarray:
    """argmin 0.5 w'Hw + g'w over the simplex (accelerated projected gradient + exact polish)."""
    M = len(g)
    w = project_simplex(np.full(M, 1.0 / M) if w0 is None else w0)
    L = max(np.linalg.eigvalsh((H + H.T) / 2).max(), 1e-12)
    z, t = w.copy(), 1.0
    for _ in range(iters):
        w_new = project_simplex(z - (H @ z + g) / L)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = w_new + (t - 1) / t_new * (w_new - w)
        if np.max(np.abs(w_new - w)) < tol:
            w = w_new
            break
        w, t = w_new, t_new
    return _polish(H, g, w)


def _polish(H, g, w):
    """Solve the KKT system on the support exactly; keep it if still feasible and better."""
    S = np.where(w > 1e-10)[0]
    if len(S) == 0:
        return w
    k = len(S)
    K = np.zeros((k + 1, k + 1))
    K[:k, :k] = H[np.ix_(S, S)]
    K[:k, k] = 1
    K[k, :k] = 1
    rhs = np.concatenate([-g[S], [1.0]])
    try:
        sol = np.linalg.lstsq(K, rhs, rcond=None)[0]
    except np.linalg.LinAlgError:
        return w
    cand = np.zeros_like(w)
    cand[S] = sol[:k]
    if (cand >= -1e-15).all():
        cand = np.maximum(cand, 0)
        cand /= cand.sum()
        f = lambda x: 0.5 * x @ H @ x + g @ x
        if f(cand) <= f(w) + 1e-15:
            return cand
    return w


def kkt_residual(w: np.ndarray, grad: np.ndarray) -> float:
    """max |w - proj(w - grad)|: zero exactly at a simplex-constrained optimum."""
    return float(np.max(np.abs(w - project_simplex(w - grad))))


# ------------------------------------------------------------------ moments (OLS, MSE blend)
def fold_moments(df: DataFrame, xs: Sequence[str], y: str, fold_col: str, n_folds: int) -> np.ndarray:
    """(K+1, M+2, M+2): cross products of (1, target, members) over the rows of each problem,
    added up over the other folds (no subtraction)."""
    size = len(xs) + 2

    def kernel(x: np.ndarray) -> np.ndarray:
        out = np.zeros((n_folds, size, size))
        for g in np.unique(x[:, 0]).astype(int):
            a = x[x[:, 0] == g].copy()
            a[:, 0] = 1.0
            out[g] += a.T @ a
        return out.ravel()

    by_fold = block_sums(df, [fold_col, y, *xs], kernel, n_folds * size * size).reshape(n_folds, size, size)
    return np.array([by_fold[[g for g in range(n_folds) if g != q]].sum(axis=0) for q in range(n_folds + 1)])


def unpack_moments(v: np.ndarray, M: int):
    """(n, sum y, sums x, sums xy, sums xx, sum yy) of one problem."""
    return v[0, 0], v[0, 1], v[0, 2:], v[1, 2:], v[2:, 2:], v[1, 1]


def ols_fit(v: np.ndarray, M: int) -> np.ndarray:
    """Intercept + M coefficients from moments (least squares; pinv for collinear members)."""
    n, sy, sx, sxy, G, _ = unpack_moments(v, M)
    A = np.zeros((M + 1, M + 1))
    A[0, 0] = n
    A[0, 1:] = A[1:, 0] = sx
    A[1:, 1:] = G
    b = np.concatenate([[sy], sxy])
    return np.linalg.lstsq(A, b, rcond=None)[0]


def mse_simplex_fit(v: np.ndarray, M: int) -> np.ndarray:
    n, _, _, sxy, G, _ = unpack_moments(v, M)
    return simplex_qp(2 * G / n, -2 * sxy / n)


class NotConverged(RuntimeError):
    """An iterative fit used up its passes; its weights are not returned as if they were the optimum."""


# ------------------------------------------------------------------ iterative fits
def linear_expr(xs: Sequence[str], w: np.ndarray, intercept: float = 0.0) -> Column:
    e = F.lit(float(intercept))
    for x, c in zip(xs, w):
        e = e + F.lit(float(c)) * F.col(x)
    return e


def _stored(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, int]:
    """The columns that every pass reads, computed once, and their number of partitions."""
    df = materialize(df.select(*cols))
    return df, df.rdd.getNumPartitions()


def convex_logloss_fit(df: DataFrame, xs: Sequence[str], y: str | None, fold_col: str, n_folds: int,
                       kind: str = "binary", max_passes: int = 40, tol: float = 1e-9, accept_tol: float = 1e-6):
    """Simplex-constrained minimum of mean log loss of clip(x.w) for all K+1 problems.

    kind='binary': p = clip(x.w, 1e-7, 1-1e-7), y in {0,1}.
    kind='true_class': x are the members' probabilities of the true class,
    p = clip(x.w, 1e-7, 1) (multiclass blend with one weight per member).
    Projected Newton with backtracking; every pass reads the rows once for all
    problems. Returns (weights (K+1, M), losses, gradients, passes).
    """
    M, Q = len(xs), n_folds + 1
    binary = kind == "binary"
    cols = [fold_col, *([y] if binary else []), *xs]
    df, parts = _stored(df, cols)
    W = np.full((Q, M), 1.0 / M)
    hi = 1 - BLEND_EPS if binary else 1.0
    width = 2 + M + M * M

    def stats(Wc):
        def kernel(x: np.ndarray) -> np.ndarray:
            use, m = _chosen(x[:, 0], n_folds), x[:, 2:] if binary else x[:, 1:]
            raw = m @ Wc.T
            p = np.clip(raw, BLEND_EPS, hi)
            inside = ((raw > BLEND_EPS) & (raw < hi)).astype(np.float64)
            if binary:
                t = x[:, 1:2]
                loss = -(t * np.log(p) + (1 - t) * np.log1p(-p))
                d1 = -(t / p - (1 - t) / (1 - p)) * inside
                d2 = (t / (p * p) + (1 - t) / ((1 - p) * (1 - p))) * inside
            else:
                loss, d1, d2 = -np.log(p), -inside / p, inside / (p * p)
            out = np.zeros((Q, width))
            out[:, 0], out[:, 1] = use.sum(axis=0), (use * loss).sum(axis=0)
            out[:, 2:2 + M] = (use * d1).T @ m
            for q in range(Q):
                out[q, 2 + M:] = ((m * (use * d2)[:, q:q + 1]).T @ m).ravel()
            return out.ravel()

        S = block_sums(df, cols, kernel, Q * width, partitions=parts).reshape(Q, width)
        n = np.where(S[:, 0] > 0, S[:, 0], 1.0)  # an empty problem stays at its start
        return S[:, 1] / n, S[:, 2:2 + M] / n[:, None], S[:, 2 + M:].reshape(Q, M, M) / n[:, None, None]

    loss, grad, hess = stats(W)
    passes = 1
    done = np.array([not np.any(hess[q]) and not np.any(grad[q]) for q in range(Q)])
    while passes < max_passes:
        for q in range(Q):
            if kkt_residual(W[q], grad[q]) < tol:
                done[q] = True
        if done.all():
            break
        D = np.zeros_like(W)
        for q in range(Q):
            if not done[q]:
                H = hess[q] + 1e-12 * np.eye(M)
                v = simplex_qp(H, grad[q] - H @ W[q], W[q])
                D[q] = v - W[q]
        step = np.ones(Q)
        while True:
            cand = W + step[:, None] * D
            c_loss, c_grad, c_hess = stats(cand)
            passes += 1
            ok = c_loss <= loss + 1e-4 * step * np.einsum("qm,qm->q", grad, D) + 1e-15
            ok |= done
            if ok.all() or passes >= max_passes:
                break
            step = np.where(ok, step, step / 2)
        accept = ok & ~done
        W[accept] = cand[accept]
        loss[accept], grad[accept], hess[accept] = c_loss[accept], c_grad[accept], c_hess[accept]
        if np.max(np.abs(D[accept]) * step[accept, None], initial=0.0) < 1e-14:
            break
    worst = max((kkt_residual(W[q], grad[q]) for q in range(Q) if np.any(hess[q]) or np.any(grad[q])), default=0.0)
    if worst > max(accept_tol, tol):
        raise NotConverged(f"convex blend: optimality residual {worst:.2e} after {passes} passes")
    return W, loss, grad, passes


def _descend(stats, B: np.ndarray, direction, max_passes: int, tol: float, accept_tol: float, what: str):
    """Minimise all problems side by side: ``stats(B)`` is (objectives, gradients, ...) of one pass,
    ``direction(B, state, old)`` the next steps. Steps are halved until each objective falls enough."""
    state, passes, old = stats(B), 1, None
    while passes < max_passes and np.max(np.abs(state[1])) >= tol:
        D = direction(B, state, old)
        step = np.ones(len(B))
        while True:
            cand = B + step[:, None] * D
            new = stats(cand)
            passes += 1
            ok = new[0] <= state[0] + 1e-4 * step * np.einsum("qm,qm->q", state[1], D) + 1e-12 * np.abs(state[0])
            if ok.all() or passes >= max_passes:
                break
            step = np.where(ok, step, step / 2)
        old = (B.copy(), state[1].copy())
        B = np.where(ok[:, None], cand, B)
        state = tuple(np.where(ok.reshape(-1, *[1] * (n.ndim - 1)), n, s) for n, s in zip(new, state))
        if np.max(np.abs(D * step[:, None])) < 1e-13:
            break
    worst = np.max(np.abs(state[1]) / np.maximum(1.0, np.abs(state[0]))[:, None])
    if worst > accept_tol:
        raise NotConverged(f"{what}: relative gradient {worst:.2e} after {passes} passes")
    return B, state, passes


def logistic_fit(df: DataFrame, xs: Sequence[str], y: str, fold_col: str, n_folds: int, C: float = 1.0,
                 max_passes: int = 30, tol: float = 1e-10, accept_tol: float = 1e-6):
    """L2 logistic regression (penalty 0.5||w||^2 + C * sum logloss, intercept free)
    for all K+1 problems by damped Newton; the rows are read once per pass.
    Returns (coef (K+1, M+1) with intercept first, gradients, passes)."""
    M, Q = len(xs), n_folds + 1
    cols = [fold_col, y, *xs]
    df, parts = _stored(df, cols)
    d = M + 1
    width = 1 + d + d * d
    reg = np.ones(d)
    reg[0] = 0.0

    def stats(Bc):
        def kernel(x: np.ndarray) -> np.ndarray:
            use, t = _chosen(x[:, 0], n_folds), x[:, 1:2]
            f = np.concatenate([np.ones((len(x), 1)), x[:, 2:]], axis=1)
            z = f @ Bc.T
            p = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
            out = np.zeros((Q, width))
            out[:, 0] = (use * (np.logaddexp(0.0, z) - t * z)).sum(axis=0)
            out[:, 1:1 + d] = (use * (p - t)).T @ f
            w = use * p * (1 - p)
            for q in range(Q):
                out[q, 1 + d:] = ((f * w[:, q:q + 1]).T @ f).ravel()
            return out.ravel()

        S = block_sums(df, cols, kernel, Q * width, partitions=parts).reshape(Q, width)
        return (C * S[:, 0] + 0.5 * np.sum(reg * Bc * Bc, axis=1), C * S[:, 1:1 + d] + reg * Bc,
                C * S[:, 1 + d:].reshape(Q, d, d) + np.diag(reg))

    def newton(B, state, _):
        return np.array([-np.linalg.solve(h + 1e-12 * np.eye(d), g) for g, h in zip(state[1], state[2])])

    B, state, passes = _descend(stats, np.zeros((Q, d)), newton, max_passes, tol, accept_tol, "logistic fit")
    return B, state[1], passes


# ------------------------------------------------------------------ multinomial
NEWTON_MOST = 400   # weights of a problem up to which the full Hessian is added up
MEMORY = 10         # remembered steps beyond


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Remembered:
    """Limited-memory quasi-Newton steps of problems side by side."""

    def __init__(self, memory: int = MEMORY):
        self.memory, self.pairs = memory, []

    def __call__(self, B: np.ndarray, state, old) -> np.ndarray:
        g = state[1]
        if old is not None:
            s, y = B - old[0], g - old[1]
            sy = np.einsum("qm,qm->q", s, y)
            self.pairs = [*self.pairs, (s, y, np.where(sy > 1e-300, sy, np.inf))][-self.memory:]  # a useless pair weighs nothing
        r, kept = g.copy(), []
        for s, y, sy in reversed(self.pairs):
            a = np.einsum("qm,qm->q", s, r) / sy
            kept.append(a)
            r -= a[:, None] * y
        if self.pairs:
            s, y, sy = self.pairs[-1]
            yy = np.einsum("qm,qm->q", y, y)
            r *= np.where(np.isfinite(sy) & (yy > 0), sy / np.where(yy > 0, yy, 1.0), 1.0)[:, None]
        else:
            r /= np.maximum(1.0, np.linalg.norm(g, axis=1))[:, None]
        for (s, y, sy), a in zip(self.pairs, reversed(kept)):
            r += (a - np.einsum("qm,qm->q", y, r) / sy)[:, None] * s
        return -r


def multinomial_fit(df: DataFrame, features: str, n_features: int, code: str, n_classes: int, fold_col: str, n_folds: int,
                    C: float = 1.0, max_passes: int = 400, tol: float = 1e-9, accept_tol: float = 1e-6, stored: bool = False):
    """L2 multinomial logistic regression (penalty 0.5||w||^2 + C * sum logloss, intercepts free) on the
    array column ``features``: first on all rows, then for the K folds in shared passes that start there. Damped
    Newton while a problem has at most ``NEWTON_MOST`` weights, limited-memory steps beyond. ``NotConverged`` if the
    passes run out. ``stored`` says that ``df`` is written already.
    Returns (coef (K+1, classes, features + 1) with the intercept first, objectives, gradients, passes)."""
    Q, d = n_folds + 1, n_features + 1
    size = n_classes * d
    df, parts = (df, df.rdd.getNumPartitions()) if stored else _stored(df, [fold_col, code, features])
    full = size <= NEWTON_MOST
    width = 1 + size + (size * size if full else 0)
    reg = np.ones((n_classes, d))
    reg[:, 0] = 0.0
    reg = reg.ravel()

    def stats(problems, flat):
        B = flat.reshape(len(problems), n_classes, d)

        def kernel(x: np.ndarray) -> np.ndarray:
            out = np.zeros((len(problems), width))
            for i, q in enumerate(problems):
                own = x if q == n_folds else x[x[:, 0] != q]
                rows, t = np.arange(len(own)), own[:, 1].astype(int)
                f = np.concatenate([np.ones((len(own), 1)), own[:, 2:]], axis=1)
                z = f @ B[i].T
                top = z.max(axis=1, keepdims=True, initial=-np.inf)
                e = np.exp(z - top)
                total = e.sum(axis=1, keepdims=True)
                p = e / total
                out[i, 0] = (top[:, 0] + np.log(total[:, 0]) - z[rows, t]).sum()
                r = p.copy()
                r[rows, t] -= 1.0
                out[i, 1:1 + size] = (r.T @ f).ravel()
                if full:  # sum of diag(p) - p p' by class, times f f'
                    g = (p[:, :, None] * f[:, None, :]).reshape(len(own), size)
                    h = -(g.T @ g)
                    same = (g.T @ f).reshape(n_classes, d, d)
                    for k in range(n_classes):
                        h[k * d:(k + 1) * d, k * d:(k + 1) * d] += same[k]
                    out[i, 1 + size:] = h.ravel()
            return out.ravel()

        S = block_sums(df, [fold_col, code], kernel, len(problems) * width, vector=features, partitions=parts).reshape(-1, width)
        state = (C * S[:, 0] + 0.5 * np.sum(reg * flat * flat, axis=1), C * S[:, 1:1 + size] + reg * flat)
        return (*state, C * S[:, 1 + size:].reshape(-1, size, size) + np.diag(reg)) if full else state

    shift = np.zeros((n_classes, d))
    shift[:, 0] = 1.0  # all intercepts together change nothing

    def newton(B, state, _):
        s = shift.ravel()
        return np.array([-np.linalg.solve(h + np.outer(s, s) + 1e-12 * np.eye(size), g) for g, h in zip(state[1], state[2])])

    def descend(problems, start):
        return _descend(lambda flat: stats(problems, flat), start, newton if full else Remembered(), max_passes,
                        tol if full else accept_tol / 10, accept_tol, "multinomial fit")

    last, end, passes = descend([n_folds], np.zeros((1, size)))
    B, state, more = descend(list(range(n_folds)), np.repeat(last, n_folds, axis=0))
    return (np.concatenate([B, last]).reshape(Q, n_classes, d), np.concatenate([state[0], end[0]]),
            np.concatenate([state[1], end[1]]), passes + more)


def multinomial_predict(df: DataFrame, coef: np.ndarray, features: str, keep: Sequence[str], problem: str | int, out: str = "probs") -> DataFrame:
    """``keep`` columns and class probabilities by the weights of a problem, or of that in column ``problem``."""
    by_row = isinstance(problem, str)
    schema = df.select(*keep, F.lit(None).cast("array<double>").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = batch.column(len(keep)).flatten().to_numpy(zero_copy_only=False).reshape(n, coef.shape[2] - 1)
            q = batch.column(len(keep) + 1).to_numpy() if by_row else np.full(n, problem)
            p = np.zeros((n, coef.shape[1]))
            for k in np.unique(q):
                rows = q == k
                p[rows] = _softmax(x[rows] @ coef[k, :, 1:].T + coef[k, :, 0])
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(list(p), pa.list_(pa.float64()))],
                                             names=[*keep, out])

    chosen = [F.col(problem).cast("int").alias("_problem")] if by_row else []
    return df.select(*keep, F.col(features).cast("array<double>").alias("_features"), *chosen).mapInArrow(run, schema)


def per_fold_expr(fold_col: str, n_folds: int, make: Callable[[int], Column]) -> Column:
    """CASE fold WHEN q THEN make(q) ... : prediction of the model that did not see the row."""
    e = None
    for q in range(n_folds):
        e = (F.when(F.col(fold_col) == q, make(q)) if e is None else e.when(F.col(fold_col) == q, make(q)))
    return e
