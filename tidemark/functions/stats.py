"""Distribution tails and time-series kernels in NumPy, for one series of up to some thousand points."""

from __future__ import annotations

import math

import numpy as np


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def t_tail(t: float, df: float) -> float:
    """Two-sided."""
    return float("nan") if not math.isfinite(t) or df <= 0 else beta_inc(df / 2, 0.5, df / (df + t * t))


def f_tail(f: float, d1: float, d2: float) -> float:
    return float("nan") if not math.isfinite(f) or d2 <= 0 else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * max(f, 0.0)))


def normal_tail(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


def ols(X: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    b = np.linalg.lstsq(X, y, rcond=None)[0]
    return b, y - X @ b


def line(n: int) -> np.ndarray:
    return np.column_stack([np.ones(n), np.arange(n, dtype=float)])


def average_ranks(x: np.ndarray) -> np.ndarray:
    _, back, count = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(count) - (count - 1) / 2)[back]


def spearman(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, b = average_ranks(x), average_ranks(y)
    if a.std() == 0 or b.std() == 0:
        return float("nan"), float("nan")
    r = float(np.corrcoef(a, b)[0, 1])
    n = len(x)
    return r, 0.0 if abs(r) >= 1 else t_tail(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def glsar(X: np.ndarray, y: np.ndarray, rounds: int = 10, tol: float = 1e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """(coefficients, their p values, rho) of a regression with AR(1) errors, iterated as SURVEY section 8.3 states."""
    n, k = X.shape
    rho, last = 0.0, None
    white = lambda z: z[1:] - rho * z[:-1]
    for _ in range(rounds - 1):
        b, _ = ols(white(X), white(y))
        if last is not None and np.max(np.abs((b - last) / last)) < tol:
            break
        last = b
        u = y - X @ b
        u = u - u.mean()
        rho = float((u[1:] @ u[:-1] / (n - 1)) / (u @ u / n))
    Xw, yw = white(X), white(y)
    b, e = ols(Xw, yw)
    df = n - 1 - k
    se = np.sqrt(np.diag(np.linalg.inv(Xw.T @ Xw)) * (e @ e) / df)
    return b, np.array([t_tail(v, df) for v in b / se]), rho


def hac_p(y: np.ndarray, lags: int = 12) -> float:
    """The slope's p value with Newey-West errors: Bartlett weights, no small-sample correction, normal tail."""
    X = line(len(y))
    b, u = ols(X, y)
    s = X * u[:, None]
    meat = s.T @ s
    for l in range(1, min(lags, len(y) - 1) + 1):
        g = s[l:].T @ s[:-l]
        meat += (1 - l / (lags + 1)) * (g + g.T)
    bread = np.linalg.inv(X.T @ X)
    return normal_tail(b[1] / math.sqrt((bread @ meat @ bread)[1, 1]))


def lowess(y: np.ndarray, frac: float = 0.2, robust: int = 3) -> np.ndarray:
    """Local lines over the k = int(frac n) nearest points with tricube weights, reweighted `robust` times by bisquares."""
    n = len(y)
    k = max(2, int(frac * n + 1e-10))
    x = np.arange(n, dtype=float)
    trust, fit = np.ones(n), np.zeros(n)
    for turn in range(robust + 1):
        for i in range(n):
            near = np.argsort(np.abs(x - i), kind="stable")[:k]
            d, h = np.abs(x[near] - i), np.abs(x[near] - i).max()
            w = np.where(d <= 0.001 * h, 1.0, np.where(d >= 0.999 * h, 0.0, (1 - (d / h) ** 3) ** 3)) * trust[near]
            if w.sum() <= 0:
                fit[i] = y[i]
                continue
            w = w / w.sum()
            m = w @ x[near]
            spread = w @ (x[near] - m) ** 2
            slope = (w @ ((x[near] - m) * y[near])) / spread if spread > 1e-12 else 0.0
            fit[i] = w @ y[near] + slope * (i - m)
        if turn == robust:
            break
        r = np.abs(y - fit)
        s = 6 * np.median(r)
        trust = np.where(r >= 0.999 * s, 0.0, np.where(r <= 0.001 * s, 1.0, (1 - (r / s) ** 2) ** 2)) if s > 0 else np.ones(n)
    return fit


def natural_spline(t: np.ndarray, df: int = 4) -> np.ndarray:
    """The natural cubic spline space of dimension df whose coefficients are the values at the knots."""
    knots = np.quantile(t, np.linspace(0, 1, df))

    def powers(x: np.ndarray) -> np.ndarray:
        cube = lambda k: np.maximum(x - k, 0) ** 3
        last = knots[-1]
        d = [(cube(k) - cube(last)) / (last - k) for k in knots[:-1]]
        return np.column_stack([np.ones_like(x), x] + [d[j] - d[-1] for j in range(df - 2)])

    return powers(t) @ np.linalg.inv(powers(knots))


def spline_f(y: np.ndarray, df: int = 4, rounds: int = 20) -> tuple[float, float]:
    """(F, p) of a spline against a line, both whitened by the spline's AR(1) coefficient."""
    n = len(y)
    t = np.arange(n) / (n - 1)
    S, L = natural_spline(t, df), np.column_stack([np.ones(n), t])
    rho = glsar(S, y, rounds)[2]
    rest = [float(((e := ols(X[1:] - rho * X[:-1], y[1:] - rho * y[:-1])[1]) @ e)) for X in (L, S)]
    f = ((rest[0] - rest[1]) / (df - 2)) / (rest[1] / (n - 1 - df))
    return f, f_tail(f, df - 2, n - 1 - df)


def binseg(y: np.ndarray, breaks: int = 3, jump: int = 5, least: int = 2) -> list[int]:
    """Change points of a piecewise-linear trend: the split of the best gain, again and again; multiples of `jump`."""
    z = (y - y.mean()) / y.std(ddof=1) if y.std() > 0 else y - y.mean()

    def cost(a: int, b: int) -> float:
        e = ols(line(b - a), z[a:b])[1]
        return float(e @ e)

    cuts = [0, len(y)]
    for _ in range(breaks):
        best = max(
            ((cost(a, b) - cost(a, k) - cost(k, b), -k) for a, b in zip(cuts, cuts[1:]) for k in range(-(-(a + least) // jump) * jump, b - least + 1, jump)),
            default=None,
        )
        if best is None:
            break
        cuts = sorted([*cuts, -best[1]])
    return cuts[1:-1]


def placebo_share(paths: int = 2000, n: int = 124, phi: float = 0.97, seed: int = 1) -> float:
    """The share of AR(1) paths from zero with |rho| > .5 and p < .001; one generator draws them in order."""
    rng, t, hits = np.random.default_rng(seed), np.arange(n), 0
    for _ in range(paths):
        x = np.zeros(n)
        for i, e in enumerate(rng.standard_normal(n - 1), 1):
            x[i] = phi * x[i - 1] + e
        r, p = spearman(t, x)
        hits += abs(r) > 0.5 and p < 0.001
    return hits / paths


def mann_whitney(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """(U of a, two-sided p): normal approximation with tie and continuity corrections."""
    n1, n2 = len(a), len(b)
    both = np.concatenate([a, b])
    u = float(average_ranks(both)[:n1].sum() - n1 * (n1 + 1) / 2)
    _, ties = np.unique(both, return_counts=True)
    n = n1 + n2
    sd = math.sqrt(n1 * n2 / 12 * ((n + 1) - (ties**3 - ties).sum() / (n * (n - 1))))
    return u, normal_tail(max(0.0, abs(u - n1 * n2 / 2) - 0.5) / sd) if sd > 0 else 1.0
