"""Moving-average, autoregressive and GARCH filters, their likelihood and its maximum.

The recursions are sequential and not linear, so a series is one group: it is filtered in NumPy, series in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import ship
from ..spec import SeriesSpec
from .moments import Value


@dataclass(frozen=True)
class Parameters:
    """phi: autoregression, theta: moving average, alpha: past squared residuals, beta: past squared deviations, psi: exogenous."""

    phi: tuple[float, ...] = (0.0,)
    theta: tuple[float, ...] = (0.0,)
    alpha: tuple[float, ...] = (0.0,)
    beta: tuple[float, ...] = (0.0,)
    c: float = 0.0
    omega: float = 0.0
    psi: tuple[float, ...] = field(default=())


def get_parameters(params: Sequence[float], p: int = 0, q: int = 0, Q: int = 0, P: int = 0, cons: bool = True) -> Parameters:  # noqa: N803
    """A flat vector taken apart: constant, p of phi, q of theta, then if Q or P is given omega, Q of alpha and P of beta."""
    rest = [float(v) for v in params]

    def take(k: int) -> tuple[float, ...]:
        out = tuple(rest[:k])
        del rest[:k]
        return out or (0.0,)

    c = take(1)[0] if cons else 0.0
    phi, theta = take(p), take(q)
    omega = take(1)[0] if Q or P else 0.0
    return Parameters(phi, theta, take(Q), take(P), c, omega)


def _past(values: np.ndarray, t: int, weights: Sequence[float]) -> float:
    k = min(t, len(weights))
    return float(np.dot(values[t - k : t][::-1], weights[:k])) if k else 0.0


def filtered(y: np.ndarray, par: Parameters, x: np.ndarray | None = None, garch: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Residuals and deviations: u_t = y_t - c - x_t psi - sum phi y - sum theta u; h_t^2 = omega + sum alpha u^2 + sum beta h^2.

    A negative variance counts as a deviation of 1e8 and ends the scan with 1 after it; residuals beyond 1e12 give 1e6
    throughout, with deviations 1. Without GARCH deviations are 1.
    """
    n = len(y)
    u, h = np.zeros(n), np.ones(n)
    u2, h2 = np.zeros(n), np.ones(n)  # their squares
    for t in range(n):
        u[t] = y[t] - par.c - _past(y, t, par.phi) - _past(u, t, par.theta)
        if x is not None and par.psi:
            u[t] -= float(np.dot(np.atleast_1d(x[t]), par.psi))
        if not abs(u[t]) < 1e12:
            return np.full(n, 1e6), np.ones(n)
        if garch:
            u2[t] = u[t] * u[t]
            v = par.omega + _past(u2, t, par.alpha) + _past(h2, t, par.beta)
            if v < 0:
                h[t:] = 1.0
                h[t] = 1e8
                return u, h
            h[t] = np.sqrt(v)
            h2[t] = h[t] * h[t]
            if not h[t] < 1e12:
                return np.full(n, 1e6), np.ones(n)
    return u, h


def loglikelihood(u: np.ndarray, h: np.ndarray) -> float:
    """The negative Gaussian log-likelihood; deviations of 0 count as 1e-8."""
    h = np.where(h == 0, 1e-8, h)
    return float(0.5 * (len(u) * np.log(2 * np.pi) + np.sum(np.log(h * h)) + np.sum((u / h) ** 2)))


def target_function(params: Sequence[float], y: np.ndarray, p: int, q: int, Q: int, P: int, cons: bool = True, model: str = "garch") -> float:  # noqa: N803
    """What estimation minimises: the negative log-likelihood of the filtered residuals."""
    if model not in ("arma", "arch", "garch"):
        raise ValueError(f"unknown model {model!r}")
    par = get_parameters(params, p, q, Q, P if model == "garch" else 0, cons)
    return loglikelihood(*filtered(y, par, garch=model != "arma"))


def minimise(f: Callable[[np.ndarray], float], x0: Sequence[float], rounds: int | None = None, tol: float = 1e-4) -> tuple[np.ndarray, float]:
    """A minimum by the simplex method of Nelder and Mead."""
    x0 = np.asarray(x0, float)
    n = len(x0)
    points = [x0] + [x0 + np.eye(n)[i] * (0.05 * x0[i] if x0[i] else 0.00025) for i in range(n)]
    s = sorted(((f(p), k, p) for k, p in enumerate(points)), key=lambda v: v[:2])
    count = n + 1
    for _ in range(rounds or 200 * n):
        if max(np.abs(p - s[0][2]).max() for _, _, p in s) <= tol and abs(s[-1][0] - s[0][0]) <= tol:
            break
        centre, worst = np.mean([p for _, _, p in s[:-1]], axis=0), s[-1]
        at = lambda k: centre + k * (centre - worst[2])
        new = at(1.0)
        value = f(new)
        if value < s[0][0]:
            far = at(2.0)
            fv = f(far)
            new, value = (far, fv) if fv < value else (new, value)
        elif value >= s[-2][0]:
            near = at(0.5) if value < worst[0] else at(-0.5)
            nv = f(near)
            if nv < min(value, worst[0]):
                new, value = near, nv
            else:
                s = [s[0]] + [(f(p), k, p) for k, p in ((k, s[0][2] + 0.5 * (p - s[0][2])) for _, k, p in s[1:])]
                s.sort(key=lambda v: v[:2])
                continue
        s[-1] = (value, count, new)
        count += 1
        s.sort(key=lambda v: v[:2])
    return s[0][2], s[0][0]


def estimation(y: np.ndarray, x0: Sequence[float], p: int = 0, q: int = 0, Q: int = 0, P: int = 0, cons: bool = True, model: str = "garch") -> tuple[Parameters, float, np.ndarray, np.ndarray]:  # noqa: N803
    """The parameters of greatest likelihood near x0, the negative log-likelihood, residuals and deviations."""
    best, value = minimise(lambda v: target_function(v, y, p, q, Q, P, cons, model), x0)
    par = get_parameters(best, p, q, Q, P if model == "garch" else 0, cons)
    u, h = filtered(y, par, garch=model != "arma")
    return par, value, u, h


def residuals(df: DataFrame, spec: SeriesSpec, par: Parameters, exogenous: Sequence[str] = (), garch: bool = True, value: Value = None, u: str = "u", h: str = "h") -> DataFrame:
    """df with residuals u and deviations h of each series: ARMA, or with alpha and beta ARMA-GARCH, or with psi ARMAX-GARCH."""
    ship(df.sparkSession)
    rows = df.withColumn("_y", spec.x(value))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{u}` double, `{h}` double"

    def run(pdf):
        pdf = pdf.sort_values(list(spec.order), ignore_index=True)
        x = pdf[list(exogenous)].to_numpy(float) if exogenous else None
        pdf[u], pdf[h] = filtered(pdf["_y"].to_numpy(float), par, x, garch)
        return pdf.drop(columns="_y")

    return rows.groupBy(*spec.keys).applyInPandas(run, schema)


def ma(df: DataFrame, spec: SeriesSpec, theta: Sequence[float], c: float = 0.0, value: Value = None, out: str = "u") -> DataFrame:
    """Residuals of a moving-average model."""
    return residuals(df, spec, Parameters(theta=tuple(theta), c=c), (), False, value, out, "_h").drop("_h")


def arma(df: DataFrame, spec: SeriesSpec, phi: Sequence[float], theta: Sequence[float], c: float = 0.0, value: Value = None, out: str = "u") -> DataFrame:
    """Residuals of an autoregressive moving-average model."""
    return residuals(df, spec, Parameters(tuple(phi), tuple(theta), c=c), (), False, value, out, "_h").drop("_h")


def fit_series(df: DataFrame, spec: SeriesSpec, x0: Sequence[float], p: int = 0, q: int = 0, Q: int = 0, P: int = 0, cons: bool = True, model: str = "garch", value: Value = None) -> DataFrame:  # noqa: N803
    """One row per series: phi, theta, alpha, beta (arrays), c, omega and the negative log-likelihood of its estimation."""
    ship(df.sparkSession)
    rows = df.select(*spec.keys, F.struct(*spec.order).alias("_t"), spec.x(value).alias("_y")).where("_y is not null")
    keys = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in spec.keys)
    series = rows.groupBy(*spec.keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_t", "_y"))), lambda v: v["_y"]).alias("ys"))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                par, nll, _, _ = estimation(np.array(row[-1], float), x0, p, q, Q, P, cons, model)
                out.append((*row[:-1], list(par.phi), list(par.theta), list(par.alpha), list(par.beta), par.c, par.omega, nll))
            yield pd.DataFrame(out, columns=[*spec.keys, "phi", "theta", "alpha", "beta", "c", "omega", "nll"])

    return series.mapInPandas(run, f"{keys}, phi array<double>, theta array<double>, alpha array<double>, beta array<double>, c double, omega double, nll double")
