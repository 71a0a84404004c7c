"""Small numeric fits used inside grouped jobs: one bounded series or matrix each."""

from __future__ import annotations

import math

import numpy as np


def garch_variances(e2: np.ndarray, omega, alpha, beta) -> np.ndarray:
    """Conditional variances (T, K) for K parameter sets at once."""
    omega, alpha, beta = (np.atleast_1d(np.asarray(v, dtype=float)) for v in (omega, alpha, beta))
    head = e2[:75]
    w = 0.94 ** np.arange(len(head))
    start = float(head @ w / w.sum())
    out = np.empty((len(e2), len(alpha)))
    s = omega + (alpha + beta) * start
    for t in range(len(e2)):
        out[t] = s
        s = omega + alpha * e2[t] + beta * s
    return out


def fit_garch(y: np.ndarray, rounds: int = 6) -> tuple[float, float, float, np.ndarray]:
    """omega, alpha, beta and conditional variance by a zooming likelihood grid (constant mean)."""
    e2 = (y - y.mean()) ** 2
    var = float(e2.mean())
    lo, hi = np.array([0.0, 0.0, 0.3]), np.array([0.4, 0.995, 2.0])
    best = None
    for _ in range(rounds):
        a, b, s = (g.ravel() for g in np.meshgrid(*[np.linspace(l, h, 9) for l, h in zip(lo, hi)], indexing="ij"))
        ok = a + b < 0.9995
        a, b, s = a[ok], b[ok], s[ok]
        omega = s * var * (1 - a - b)
        v = np.maximum(garch_variances(e2, omega, a, b), 1e-12)
        ll = -0.5 * (np.log(v) + e2[:, None] / v).sum(axis=0)
        k = int(np.argmax(ll))
        best = (omega[k], a[k], b[k], v[:, k])
        width = (hi - lo) / 4
        mid = np.array([a[k], b[k], s[k]])
        lo, hi = np.maximum(mid - width, [0.0, 0.0, 1e-3]), np.minimum(mid + width, [1.0, 0.9995, 50.0])
    return best  # type: ignore[return-value]


def dcc_scores(z: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pseudo log-likelihoods and final correlations of dynamic-correlation filters; rows of ``z`` are days.

    All parameter pairs run side by side. A day's shock enters the state before that day is scored.
    """
    mean = np.corrcoef(z, rowvar=False)
    pull, a, b = ((1 - a - b)[:, None, None] * mean), a[:, None, None], b[:, None, None]
    state, ll = np.broadcast_to(mean, (len(a), *mean.shape)).copy(), np.zeros(len(a))
    corr = state
    for e in z:
        state = pull + a * np.outer(e, e) + b * state
        scale = np.sqrt(np.einsum("gii->gi", state))
        scale[scale == 0] = 1e-10
        corr = state / (scale[:, :, None] * scale[:, None, :])
        sign, logdet = np.linalg.slogdet(corr)
        ok = sign > 0
        solved = np.linalg.solve(np.where(ok[:, None, None], corr, np.eye(len(e))), np.broadcast_to(e[:, None], (len(a), len(e), 1)))
        ll = np.where(ok, ll - 0.5 * (logdet + solved[:, :, 0] @ e - e @ e), -np.inf)
    corr = np.clip(corr, -1, 1)
    np.einsum("gii->gi", corr)[:] = 1.0
    return ll, corr


def _gauss_log(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(mean)))
    for k in range(len(mean)):
        c = np.linalg.cholesky(cov[k])
        u = np.linalg.solve(c, (x - mean[k]).T)
        out[:, k] = -0.5 * ((u**2).sum(axis=0) + x.shape[1] * math.log(2 * math.pi)) - np.log(np.diag(c)).sum()
    return out


def _smooth(logb: np.ndarray, start: np.ndarray, trans: np.ndarray):
    """Scaled forward-backward: posteriors, summed transition posteriors, log-likelihood."""
    t, k = logb.shape
    top = logb.max(axis=1, keepdims=True)
    b = np.exp(logb - top)
    f, g, c = np.empty((t, k)), np.ones((t, k)), np.empty(t)
    f[0] = start * b[0]
    c[0] = f[0].sum()
    f[0] /= c[0]
    for i in range(1, t):
        f[i] = (f[i - 1] @ trans) * b[i]
        c[i] = f[i].sum()
        f[i] /= c[i]
    for i in range(t - 2, -1, -1):
        g[i] = trans @ (b[i + 1] * g[i + 1]) / c[i + 1]
    post = f * g
    xi = (f[:-1].T @ (b[1:] * g[1:] / c[1:, None])) * trans
    return post / post.sum(axis=1, keepdims=True), xi, float(np.log(c).sum() + top.sum())


def fit_hmm(x: np.ndarray, states: int = 3, iters: int = 100, tol: float = 1e-4, order_by: int = 1):
    """Gaussian hidden Markov model by EM, started from quantile groups of one feature.

    Returns start, transition, means and covariances with states ordered by total variance.
    """
    n, d = x.shape
    group = np.minimum(np.argsort(np.argsort(x[:, order_by], kind="stable")) * states // n, states - 1)
    ridge = 1e-6 * np.eye(d) * max(float(np.var(x, axis=0).mean()), 1e-12) + 1e-10 * np.eye(d)
    mean = np.array([x[group == k].mean(axis=0) for k in range(states)])
    cov = np.array([np.cov(x[group == k].T) + ridge for k in range(states)])
    start, trans = np.full(states, 1 / states), np.full((states, states), 0.1 / (states - 1))
    np.fill_diagonal(trans, 0.9)
    last = -math.inf
    for _ in range(iters):
        post, xi, ll = _smooth(_gauss_log(x, mean, cov), start, trans)
        if abs(ll - last) < tol:
            break
        last = ll
        start = post[0]
        trans = xi + 1e-12
        trans = trans / trans.sum(axis=1, keepdims=True)
        weight = post.sum(axis=0) + 1e-12
        mean = (post.T @ x) / weight[:, None]
        for k in range(states):
            e = x - mean[k]
            cov[k] = (post[:, k, None] * e).T @ e / weight[k] + ridge
    order = np.argsort([np.trace(c) for c in cov], kind="stable")
    return start[order], trans[order][:, order], mean[order], cov[order]


def hmm_state(x: np.ndarray, model) -> tuple[int, np.ndarray]:
    """Last state of the most likely path and the last posterior."""
    start, trans, mean, cov = model
    logb = _gauss_log(x, mean, cov)
    with np.errstate(divide="ignore"):
        lt, score = np.log(trans), np.log(start) + logb[0]
    for i in range(1, len(x)):
        score = (score[:, None] + lt).max(axis=0) + logb[i]
    post, _, _ = _smooth(logb, start, trans)
    return int(np.argmax(score)), post[-1]


def change_points(y: np.ndarray, penalty: float = 10.0, min_size: int = 20, jump: int = 1) -> list[int]:
    """Optimal segmentation under a Gaussian-kernel cost with pruning (one bounded series)."""
    n = len(y)
    if n < 2 * min_size:
        return []
    sq = (y[:, None] - y[None, :]) ** 2
    med = float(np.median(sq[np.triu_indices(n, 1)]))
    gram = np.exp(-np.clip(sq / med if med > 0 else sq, 1e-2, 1e2))
    np.fill_diagonal(gram, 1.0)
    cum = np.zeros((n + 1, n + 1))
    cum[1:, 1:] = gram.cumsum(axis=0).cumsum(axis=1)
    best, back = {0: 0.0}, {0: 0}
    ends = [t for t in range(jump, n, jump) if t >= min_size] + [n]
    starts = [0]
    for t in ends:
        s = np.array([v for v in starts if t - v >= min_size])
        if len(s) == 0:
            continue
        block = cum[t, t] - cum[s, t] - cum[t, s] + cum[s, s]
        cost = np.array([best[v] for v in s]) + (t - s) - block / (t - s)
        total = cost + penalty
        k = int(np.argmin(total))
        best[t], back[t] = float(total[k]), int(s[k])
        drop = set(s[cost > best[t]].tolist())
        starts = [v for v in starts if v not in drop] + [t]
    out, t = [], n
    while back.get(t, 0) > 0:
        t = back[t]
        out.append(t)
    return sorted(out)


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p value of Student's t by the continued fraction of the incomplete beta function."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x > (a + 1) / (a + b + 2):
        return 1 - front * _beta_fraction(1 - x, b, a) / b
    return front * _beta_fraction(x, a, b) / a


def _beta_fraction(x: float, a: float, b: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def pc_edges(corr: np.ndarray, n: int, alpha: float) -> list[tuple[int, int]]:
    """Directed edges of the PC search on a correlation matrix with Fisher-z tests."""
    from itertools import combinations

    k = len(corr)
    adj = ~np.eye(k, dtype=bool)
    separated: dict[tuple[int, int], set[int]] = {}

    def independent(i: int, j: int, cond: tuple[int, ...]) -> bool:
        inv = np.linalg.pinv(corr[np.ix_((i, j, *cond), (i, j, *cond))])
        r = float(np.clip(-inv[0, 1] / math.sqrt(inv[0, 0] * inv[1, 1]), -0.999999999, 0.999999999))
        z = 0.5 * math.log((1 + r) / (1 - r)) * math.sqrt(max(n - len(cond) - 3, 1))
        return normal_two_sided(z) > alpha

    size = 0
    while any(adj[i].sum() - 1 >= size for i in range(k)):
        for i in range(k):
            for j in [j for j in range(k) if adj[i, j]]:
                others = [v for v in range(k) if adj[i, v] and v != j]
                for cond in combinations(others, size):
                    if independent(i, j, cond):
                        adj[i, j] = adj[j, i] = False
                        separated[(i, j)] = separated[(j, i)] = set(cond)
                        break
        size += 1
    arrow = np.zeros((k, k), dtype=bool)
    for i, j in combinations(range(k), 2):
        if not adj[i, j]:
            for v in range(k):
                if adj[i, v] and adj[j, v] and v not in separated.get((i, j), set()):
                    arrow[i, v] = arrow[j, v] = True
    changed = True
    while changed:
        changed = False
        for a in range(k):
            for b in range(k):
                if adj[a, b] and not arrow[a, b] and not arrow[b, a]:
                    chain = any(arrow[c, a] and not arrow[a, c] and not adj[c, b] for c in range(k) if c != b)
                    loop = any(
                        arrow[a, c] and not arrow[c, a] and arrow[c, b] and not arrow[b, c] for c in range(k)
                    )
                    if chain or loop:
                        arrow[a, b] = changed = True
    return [(i, j) for i in range(k) for j in range(k) if arrow[i, j] and not arrow[j, i]]
