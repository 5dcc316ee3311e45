"""Portfolio weights from a matrix of returns (rows: time, columns: assets), in NumPy; they run inside one window's group."""

from __future__ import annotations

import numpy as np


def covariance(x: np.ndarray, ddof: int = 1) -> np.ndarray:
    return np.atleast_2d(np.cov(x, rowvar=False, ddof=ddof))


def bounded(w: np.ndarray, low: float = 0.0, up: float = 1.0, total: float = 1.0, rounds: int = 1000) -> np.ndarray:
    """w clipped to its bounds and rescaled to its sum, again and again until both hold."""
    w = np.asarray(w, float)
    if up < total / w.size or low > total / w.size:
        raise ValueError("bounds leave no weights with this sum")
    for _ in range(rounds):
        if w.min() >= low and w.max() <= up:
            break
        w = np.clip(w, low, up)
        w = total * w / w.sum()
    return w


def project(v: np.ndarray, low: float, up: float) -> np.ndarray:
    """The nearest point with sum 1 within the bounds: v shifted by a constant and clipped; the constant by bisection."""
    a, b = (v - up).min() - 1, (v - low).max() + 1
    for _ in range(100):
        m = (a + b) / 2
        if np.clip(v - m, low, up).sum() > 1:
            a = m
        else:
            b = m
    return np.clip(v - (a + b) / 2, low, up)


def descend(f, g, w: np.ndarray, low: float, up: float, rounds: int = 2000, tol: float = 1e-14) -> np.ndarray:
    """Projected gradient descent with a step that halves until the value falls and grows again after it."""
    step, value = 1.0, f(w)
    for _ in range(rounds):
        grad = g(w)
        while step > 1e-18:
            new = project(w - step * grad, low, up)
            fresh = f(new)
            if fresh <= value - 1e-4 / step * np.sum((new - w) ** 2):
                break
            step /= 2
        if value - fresh < tol * max(1.0, abs(value)) and np.abs(new - w).max() < 1e-10:
            return new
        w, value, step = new, fresh, step * 2
    return w


def _limits(n: int, low: float, up: float) -> tuple[float, float]:
    return min(low, 1 / n), max(up, 1 / n)


def mvp(x: np.ndarray, normalize: bool = False) -> np.ndarray:
    """Least variance with sum 1, weights of any sign; shifted to be positive if normalize."""
    v = covariance(x)
    e = np.ones(len(v))
    try:
        w = np.linalg.solve(v, e)
        if not np.isfinite(w).all():
            raise np.linalg.LinAlgError
    except np.linalg.LinAlgError:
        w = np.linalg.pinv(v) @ e
    w = w / w.sum()
    if normalize:
        w = w - min(0.0, w.min())
        w = w / w.sum()
    return w


def mvp_uc(x: np.ndarray, w0: np.ndarray | None = None, up_bound: float = 1.0, low_bound: float = 0.0) -> np.ndarray:
    """Least variance with sum 1 within bounds."""
    v = covariance(x)
    n = len(v)
    low, up = _limits(n, low_bound, up_bound)
    v = v / max(np.trace(v) / n, 1e-300)
    w = np.full(n, 1 / n) if w0 is None else project(np.asarray(w0, float).ravel(), low, up)
    return descend(lambda w: w @ v @ w, lambda w: 2 * v @ w, w, low, up)


def erc(x: np.ndarray, w0: np.ndarray | None = None, up_bound: float = 1.0, low_bound: float = 0.0) -> np.ndarray:
    """Equal risk contributions: each w_i * (V w)_i alike, sum 1, within bounds."""
    v = covariance(x)
    n = len(v)
    low, up = _limits(n, low_bound, up_bound)
    v = v / max(np.trace(v) / n, 1e-300)
    d = np.maximum(np.diag(v), 1e-12)
    y = 1 / np.sqrt(d)  # cyclic coordinates of y'Vy/2 - sum(log y) / n, whose minimum has equal contributions
    for _ in range(500):
        old = y.copy()
        for i in range(n):
            c = v[i] @ y - v[i, i] * y[i]
            y[i] = (-c + np.sqrt(c * c + 4 * d[i] / n)) / (2 * d[i])
        if np.abs(y - old).max() < 1e-12 * np.abs(y).max():
            break
    w = y / y.sum()
    if w.min() >= low and w.max() <= up:
        return w

    def f(w: np.ndarray) -> float:
        r = w * (v @ w)
        return n * r @ r - r.sum() ** 2

    def g(w: np.ndarray) -> np.ndarray:
        s = v @ w
        r = w * s
        t = 2 * n * r - 2 * r.sum()
        return t * s + v @ (t * w)

    return descend(f, g, project(w if w0 is None else np.asarray(w0, float).ravel(), low, up), low, up)


def mdp(x: np.ndarray, w0: np.ndarray | None = None, up_bound: float = 1.0, low_bound: float = 0.0) -> np.ndarray:
    """Greatest diversified ratio with sum 1 within bounds."""
    v = covariance(x, 0)
    n = len(v)
    low, up = _limits(n, low_bound, up_bound)
    v = v / max(np.trace(v) / n, 1e-300)
    s = np.sqrt(np.maximum(np.diag(v), 0))

    def f(w: np.ndarray) -> float:
        return 0.5 * np.log(max(w @ v @ w, 1e-300)) - np.log(max(w @ s, 1e-300))

    def g(w: np.ndarray) -> np.ndarray:
        return v @ w / max(w @ v @ w, 1e-300) - s / max(w @ s, 1e-300)

    return descend(f, g, np.full(n, 1 / n) if w0 is None else project(np.asarray(w0, float).ravel(), low, up), low, up)


def ivp(x: np.ndarray, normalize: bool = False, low_bound: float = 0.0, up_bound: float = 1.0) -> np.ndarray:
    """Weights in proportion to inverse variances."""
    w = 1 / np.maximum(np.diag(covariance(x)), 1e-300)
    w = w / w.sum()
    if normalize:
        w = w - w.min()
        w = w / w.sum()
    low, up = _limits(len(w), low_bound, up_bound)
    return bounded(w, low, up)


def linkage(d: np.ndarray, method: str = "single") -> list[tuple[int, int]]:
    """Merges of agglomerative clustering on a distance matrix: pairs of cluster ids, new ones numbered on from n."""
    n = len(d)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    ids, size, alive, out = list(range(n)), [1] * n, list(range(n)), []
    join = {"single": np.minimum, "complete": np.maximum}
    if method not in (*join, "average"):
        raise ValueError(f"unknown linkage method {method!r}")
    for k in range(n - 1):
        sub = d[np.ix_(alive, alive)]
        i, j = sorted(np.unravel_index(np.argmin(sub), sub.shape))
        a, b = alive[i], alive[j]
        out.append(tuple(sorted((ids[a], ids[b]))))
        d[a] = join[method](d[a], d[b]) if method in join else (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[:, a] = d[a]
        d[a, a] = np.inf
        ids[a], size[a] = n + k, size[a] + size[b]
        alive.remove(b)
    return out


def hrp(x: np.ndarray, method: str = "single", low_bound: float = 0.0, up_bound: float = 1.0) -> np.ndarray:
    """Hierarchical risk parity: cluster by correlation distance, order the leaves, split the budget by inverse variance."""
    v = covariance(x)
    n = len(v)
    s = np.sqrt(np.diag(v))
    with np.errstate(divide="ignore", invalid="ignore"):
        corr = np.nan_to_num(v / np.outer(s, s))
    merges = linkage(np.sqrt(np.clip((1 - corr) / 2, 0, None)), method)

    def leaves(c: int) -> list[int]:
        return [c] if c < n else [*leaves(merges[c - n][0]), *leaves(merges[c - n][1])]

    w = np.ones(n)

    def variance(items: list[int]) -> float:
        sub = v[np.ix_(items, items)]
        u = 1 / np.maximum(np.diag(sub), 1e-300)
        u = u / u.sum()
        return float(u @ sub @ u)

    def split(items: list[int]) -> None:
        if len(items) < 2:
            return
        left, right = items[: len(items) // 2], items[len(items) // 2 :]
        a, b = variance(left), variance(right)
        share = 1 - a / (a + b) if a + b > 0 else 0.5
        w[left] *= share
        w[right] *= 1 - share
        split(left)
        split(right)

    split(leaves(2 * n - 2) if n > 1 else [0])
    low, up = _limits(n, low_bound, up_bound)
    return bounded(w, low, up)


METHODS = {"ERC": erc, "HRP": hrp, "IVP": ivp, "MDP": mdp, "MVP": mvp, "MVP_uc": mvp_uc}
