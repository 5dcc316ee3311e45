"""Risk and return metrics. Scalars give a row per series (keys and one column), rolling ones add a column.

A ratio by zero is NULL unless its rule says otherwise. Returns are NULL-free: the first one is 0 and counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import frames as W
from ..spec import SeriesSpec, check_ddof, check_kind, no_zeros, window
from . import moments as M
from .moments import Value

_INF = float("inf")


def _order(spec: SeriesSpec) -> Column:
    return F.struct(*[F.col(c) for c in spec.order])


def _present(df: DataFrame, spec: SeriesSpec, value: Value = None) -> tuple[DataFrame, str]:
    """The rows with a value, in a column of its own."""
    x = W.temporary(df, "x")
    return df.withColumn(x, spec.x(value)).where(F.col(x).isNotNull()), x


def _annual_return(x: str, spec: SeriesSpec, period: float, ddof: int) -> Column:
    first, last, n = F.min_by(x, _order(spec)), F.max_by(x, _order(spec)), F.count(x)
    ratio = F.try_divide(last, first)
    growth = F.when(n > ddof, F.pow(ratio, F.try_divide(F.lit(float(period)), n - ddof)))
    bad = F.raise_error(F.lit("annual_return: a series must not start with zero")).cast("double")
    crossed = F.raise_error(F.lit("annual_return: a series must not change its sign")).cast("double")
    return F.when(first == 0, bad).when(ratio < 0, crossed).otherwise(F.signum(first) * growth - 1)


def accuracy(df: DataFrame, spec: SeriesSpec, y_true: str, y_pred: str, sign: bool = True, out: str = "accuracy") -> DataFrame:
    """Share of rows whose prediction is right, by sign or exactly; NaN and NULL count as wrong."""
    a, b = (F.col(c).cast("double") for c in (y_true, y_pred))
    same = (F.signum(a) == F.signum(b)) if sign else (a == b)
    right = F.coalesce(same & ~F.isnan(a) & ~F.isnan(b), F.lit(False))
    return df.groupBy(*spec.keys).agg(F.avg(right.cast("double")).alias(out))


def annual_return(df: DataFrame, spec: SeriesSpec, period: float = 252, ddof: int = 0, value: Value = None, out: str = "annual_return") -> DataFrame:
    """sign(x_0) * (x_T / x_0)^(period / (T - ddof)) - 1; raises if a series starts with zero or changes its sign."""
    check_ddof(ddof)
    df, x = _present(df, spec, value)
    return df.groupBy(*spec.keys).agg(_annual_return(x, spec, period, ddof).alias(out))


def returns(df: DataFrame, spec: SeriesSpec, log: bool = True, value: Value = None, out: str = "ret", validate: bool = True) -> DataFrame:
    """Logarithmic or relative returns, the first one 0; zeros raise unless validate is False, and then give NULL."""
    x = spec.x(value)
    step = F.try_divide(no_zeros(x, validate), F.lag(x).over(spec.by))
    change = F.ln(F.when(step > 0, step)) if log else step - 1
    first = F.row_number().over(spec.by) == 1
    return df.withColumn(out, F.when(first, F.lit(0.0)).otherwise(change))


def _volatility(r: str, period: float, ddof: int) -> Column:
    n = F.count(r)
    return F.when(n > ddof, F.sqrt(F.lit(float(period))) * F.stddev_pop(r) * F.sqrt(F.try_divide(n.cast("double"), n - ddof)))


def annual_volatility(df: DataFrame, spec: SeriesSpec, period: float = 252, log: bool = True, ddof: int = 0, value: Value = None, out: str = "annual_volatility") -> DataFrame:
    """sqrt(period) times the deviation of returns, the leading 0 among them."""
    check_ddof(ddof)
    df, x = _present(df, spec, value)
    r = W.temporary(df, "r")
    return returns(df, spec, log, x, r).groupBy(*spec.keys).agg(_volatility(r, period, ddof).alias(out))


def sharpe(df: DataFrame, spec: SeriesSpec, rf: float = 0.0, period: float = 252, log: bool = False, ddof: int = 0, value: Value = None, out: str = "sharpe") -> DataFrame:
    """(annual return - rf) / annual volatility; infinite where that is 0."""
    check_ddof(ddof)
    df, x = _present(df, spec, value)
    r = W.temporary(df, "r")
    agg = returns(df, spec, log, x, r).groupBy(*spec.keys).agg(_annual_return(x, spec, period, ddof).alias("_a"), _volatility(r, period, ddof).alias("_v"))
    return agg.select(*spec.keys, F.when(F.col("_v") == 0, F.lit(_INF)).otherwise(F.try_divide(F.col("_a") - float(rf), F.col("_v"))).alias(out))


def mad(df: DataFrame, spec: SeriesSpec, value: Value = None, out: str = "mad") -> DataFrame:
    """Mean absolute distance from the mean."""
    df, x = _present(df, spec, value)
    m = df.groupBy(*spec.keys).agg(F.avg(x).alias("_m"))
    joined = df.join(m, list(spec.keys))
    return joined.groupBy(*spec.keys).agg(F.avg(F.abs(F.col(x) - F.col("_m"))).alias(out))


def fall(x: Column, peak: Column, first: Column, raw: bool) -> Column:
    """How far x is below the peak; in the value's own unit where a series starts with zero."""
    if raw:
        return peak - x
    return F.when(first == 0, peak - x).otherwise(1 - F.try_divide(x, peak))


def drawdown(df: DataFrame, spec: SeriesSpec, raw: bool = False, value: Value = None, out: str = "drawdown") -> DataFrame:
    """Distance from the greatest value so far, as a share of it unless raw or the series starts with zero."""
    x = spec.x(value)
    return df.withColumn(out, fall(x, W.maximum(x, spec, None), F.first(x, True).over(spec.expanding), raw))


def mdd(df: DataFrame, spec: SeriesSpec, raw: bool = False, value: Value = None, out: str = "mdd") -> DataFrame:
    """Greatest drawdown."""
    df, x = _present(df, spec, value)
    d = W.temporary(df, "d")
    return drawdown(df, spec, raw, x, d).groupBy(*spec.keys).agg(F.max(d).alias(out))


def calmar(df: DataFrame, spec: SeriesSpec, period: float = 252, ddof: int = 0, value: Value = None, out: str = "calmar") -> DataFrame:
    """Annual return over the greatest drawdown; 0 without one."""
    check_ddof(ddof)
    df, x = _present(df, spec, value)
    d = W.temporary(df, "d")
    agg = drawdown(df, spec, False, x, d).groupBy(*spec.keys).agg(_annual_return(x, spec, period, ddof).alias("_a"), F.max(d).alias("_d"))
    return agg.select(*spec.keys, F.when(F.col("_d") == 0, 0.0).otherwise(F.try_divide("_a", "_d")).alias(out))


def z_score(df: DataFrame, spec: SeriesSpec, w: int | None = None, kind: str = "s", value: Value = None, out: str = "z_score") -> DataFrame:
    """The last rolling z-score of each series."""
    df, x = _present(df, spec, value)
    z = W.temporary(df, "z")
    return roll_z_score(df, spec, w, kind, x, z).groupBy(*spec.keys).agg(F.max_by(z, _order(spec)).alias(out))


def diversified_ratio(df: DataFrame, spec: SeriesSpec, weights: DataFrame | None = None, value: Value = None) -> DataFrame:
    """One row: the weighted mean of the series' deviations over the deviation of their weighted sum (columns: ratio).

    The deviation of the weighted sum is taken from the sum itself, row by row, so no covariance matrix is built. weights
    has the keys and a column weight; without it all series weigh alike. Rows where a series has no value are left out.
    """
    df, x = _present(df, spec, value)
    names = df.groupBy(*spec.keys).agg(F.count("*").alias("_n"))
    n = names.count()
    if weights is None:
        df = df.withColumn("_w", F.lit(1.0 / max(1, n)))
    else:
        df = df.join(weights.select(*spec.keys, F.col("weight").cast("double").alias("_w")), list(spec.keys))
    full = df.groupBy(*spec.order).agg(F.count("*").alias("_c"), F.sum(F.col(x) * F.col("_w")).alias("_p")).where(F.col("_c") == n)
    common = df.join(full, list(spec.order))
    each = common.groupBy(*spec.keys).agg((F.first("_w") * F.stddev_pop(x)).alias("_s"))
    top = each.agg(F.sum("_s").alias("_s"))
    return top.crossJoin(full.agg(F.stddev_pop("_p").alias("_v"))).select(F.try_divide("_s", "_v").alias("ratio"))


def loglikelihood(df: DataFrame, spec: SeriesSpec, u: str, h: str, out: str = "loglikelihood") -> DataFrame:
    """The negative Gaussian log-likelihood of residuals u with deviations h; a deviation of 0 counts as 1e-8."""
    d = F.when(F.col(h) == 0, 1e-8).otherwise(F.col(h).cast("double"))
    each = F.ln(d * d) + F.pow(F.col(u) / d, 2) + F.ln(F.lit(2.0) * F.pi())
    return df.groupBy(*spec.keys).agg((F.sum(each) / 2).alias(out))


# Rolling metrics


def roll_annual_return(df: DataFrame, spec: SeriesSpec, period: float = 252, w: int | None = None, ddof: int = 0, value: Value = None, out: str = "roll_annual_return") -> DataFrame:
    """(x_t / first of the frame)^(period / (k - ddof)) - 1; 0 while the frame has no more than ddof values."""
    check_ddof(ddof, window(w))
    x = spec.x(value)
    k = W.count(x, spec, w)
    ratio = F.try_divide(x, F.first(x, ignorenulls=True).over(spec.last(w)))
    return df.withColumn(out, F.when(k <= ddof, 0.0).otherwise(F.pow(ratio, F.try_divide(F.lit(float(period)), k - ddof)) - 1))


def roll_annual_volatility(df: DataFrame, spec: SeriesSpec, period: float = 252, log: bool = True, w: int | None = None, ddof: int = 0, value: Value = None, out: str = "roll_annual_volatility") -> DataFrame:
    """sqrt(period) times the rolling deviation of the last w returns, the leading 0 among them."""
    r = W.temporary(df, "r")
    df = returns(df, spec, log, value, r)
    return df.withColumn(out, F.sqrt(F.lit(float(period))) * W.deviation(F.col(r), spec, w, ddof)).drop(r)


def roll_sharpe(df: DataFrame, spec: SeriesSpec, rf: float | str = 0.0, period: float = 252, w: int | None = None, log: bool = False, ddof: int = 0, value: Value = None, out: str = "roll_sharpe") -> DataFrame:
    """(rolling annual return - rf) / rolling annual volatility; 0 where that is 0. rf may be a column's name."""
    a, v = W.temporary(df, "a"), W.temporary(df, "v")
    df = roll_annual_return(df, spec, period, w, ddof, value, a)
    df = roll_annual_volatility(df, spec, period, log, w, ddof, value, v)
    free = F.col(rf).cast("double") if isinstance(rf, str) else F.lit(float(rf))
    return df.withColumn(out, F.when(F.col(v) == 0, 0.0).otherwise(F.try_divide(F.col(a) - free, F.col(v)))).drop(a, v)


def roll_drawdown(df: DataFrame, spec: SeriesSpec, w: int | None = None, raw: bool = False, value: Value = None, out: str = "roll_drawdown") -> DataFrame:
    """Distance from the greatest value of the frame."""
    x = spec.x(value)
    return df.withColumn(out, fall(x, W.maximum(x, spec, w), F.first(x, True).over(spec.expanding), raw))


def roll_mdd(df: DataFrame, spec: SeriesSpec, w: int | None = None, raw: bool = False, value: Value = None, out: str = "roll_mdd") -> DataFrame:
    """Greatest drawdown within the frame, the peak starting anew with it."""
    if window(w) is None:
        d = W.temporary(df, "d")
        return drawdown(df, spec, raw, value, d).withColumn(out, F.max(d).over(spec.expanding)).drop(d)
    a = W.temporary(df, "frame")
    df = df.withColumn(a, W.values(spec.x(value), spec, w))
    array = F.col(a)
    start = F.struct(F.get(array, F.lit(0)).alias("p"), F.lit(0.0).alias("d"))

    def step(s: Column, v: Column) -> Column:
        p = F.greatest(s["p"], v)
        return F.struct(p.alias("p"), F.greatest(s["d"], p - v if raw else 1 - F.try_divide(v, p)).alias("d"))

    return df.withColumn(out, F.aggregate(array, start, step, lambda s: s["d"])).drop(a)


def roll_mad(df: DataFrame, spec: SeriesSpec, w: int | None = None, value: Value = None, out: str = "roll_mad") -> DataFrame:
    """Mean absolute distance of the frame's values from their mean."""
    x = spec.x(value)
    a, m = W.temporary(df, "frame"), W.temporary(df, "m")
    df = df.withColumn(a, W.values(x, spec, w)).withColumn(m, W.mean(x, spec, w))
    return df.withColumn(out, F.try_divide(W.added(F.col(a), lambda v: F.abs(v - F.col(m))), F.size(a))).drop(a, m)


def roll_calmar(df: DataFrame, spec: SeriesSpec, period: float = 252, w: int | None = None, ddof: int = 0, value: Value = None, out: str = "roll_calmar") -> DataFrame:
    """Rolling annual return over the frame's greatest drawdown; 0 without one."""
    a, d = W.temporary(df, "a"), W.temporary(df, "d")
    df = roll_annual_return(df, spec, period, w, ddof, value, a)
    df = roll_mdd(df, spec, w, False, value, d)
    return df.withColumn(out, F.when(F.col(d) == 0, 0.0).otherwise(F.try_divide(F.col(a), F.col(d)))).drop(a, d)


def roll_z_score(df: DataFrame, spec: SeriesSpec, w: int | None = None, kind: str = "s", value: Value = None, out: str = "roll_z_score") -> DataFrame:
    """Distance from the moving average in moving deviations, which count as 1 where they are 0."""
    x = spec.x(value)
    m, s = W.temporary(df, "m"), W.temporary(df, "s")
    df = M.moving_average(df, spec, w, kind, value, m)
    df = M.moving_deviation(df, spec, w, kind, value, s)
    return df.withColumn(out, (x - F.col(m)) / F.when(F.col(s) == 0, 1.0).otherwise(F.col(s))).drop(m, s)


# Performance


def perf_index(df: DataFrame, spec: SeriesSpec, base: float = 100.0, value: Value = None, out: str = "perf_index") -> DataFrame:
    """The series rebased to start with base."""
    x = spec.x(value)
    return df.withColumn(out, F.try_divide(float(base) * x, F.first(x, ignorenulls=True).over(spec.expanding)))


def perf_returns(df: DataFrame, spec: SeriesSpec, kind: str = "raw", base: float = 100.0, value: Value = None, out: str = "perf_returns") -> DataFrame:
    """The index that returns of a kind (raw, log or pct) add up to, rebased to start with base."""
    kind = check_kind(kind, ("raw", "log", "pct"))
    r, p = spec.x(value), W.temporary(df, "p")
    if kind == "raw":
        level = float(base) + F.sum(r).over(spec.expanding)
    elif kind == "log":
        level = float(base) * F.exp(F.sum(r).over(spec.expanding))
    else:
        level = float(base) * F.product(1 + r).over(spec.expanding)
    return perf_index(df.withColumn(p, level), spec, base, p, out).drop(p)


def returns_strat(df: DataFrame, spec: SeriesSpec, signal: str | None = None, kind: str = "pct", base: float = 100.0, value: Value = None, out: str = "returns_strat") -> DataFrame:
    """Returns (pct, or raw ones of the series rebased to base) times the signal of the same row; the first is 0."""
    kind = check_kind(kind, ("raw", "pct"))
    p = W.temporary(df, "p")
    df = perf_index(df, spec, base, value, p)
    before = F.lag(p).over(spec.by)
    change = F.col(p) - before if kind == "raw" else F.try_divide(F.col(p), before) - 1
    s = F.lit(1.0) if signal is None else F.col(signal).cast("double")
    return df.withColumn(out, F.coalesce(change, F.lit(0.0)) * s).drop(p)


def perf_strat(df: DataFrame, spec: SeriesSpec, signal: str | None = None, base: float = 100.0, reinvest: bool = False, value: Value = None, out: str = "perf_strat") -> DataFrame:
    """The index of a strategy that holds signal of the series, with or without reinvesting gains."""
    r = W.temporary(df, "r")
    kind = "pct" if reinvest else "raw"
    df = returns_strat(df, spec, signal, kind, base, value, r)
    return perf_returns(df, spec, kind, base, r, out).drop(r)


def perf_signal(df: DataFrame, spec: SeriesSpec, signal: str, value: Value = None, base: float = 100.0, log: bool = True, out: str = "perf_signal") -> DataFrame:
    """base compounded over signal times returns, logarithmic (exp of their sum) or relative (product of 1 + them)."""
    r = spec.x(value) * F.col(signal).cast("double")
    level = F.exp(F.sum(r).over(spec.expanding)) if log else F.product(1 + r).over(spec.expanding)
    return df.withColumn(out, float(base) * level)


def perf_fees(df: DataFrame, spec: SeriesSpec, signal: str, fee: float = 0.0, value: Value = None, abs_fees: bool = False, base: float = 1.0, out: str = "perf_fees") -> DataFrame:
    """base times the product of (e^r - 1 - fees) * signal + 1 over log returns; fees are fee times the signal's change.

    The change is signed, so that selling earns what buying costs, unless abs_fees is set.
    """
    f = W.temporary(df, "f")
    s = F.col(signal).cast("double")
    change = F.coalesce(s - F.lag(s).over(spec.by), F.lit(0.0))
    df = df.withColumn(f, (F.abs(change) if abs_fees else change) * float(fee))
    gain = (F.exp(spec.x(value)) - 1 - F.col(f)) * s + 1
    return df.withColumn(out, float(base) * F.product(gain).over(spec.expanding)).drop(f)
