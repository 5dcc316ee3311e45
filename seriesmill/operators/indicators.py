"""Technical indicators and position sizing. Windows are rows; for kind e a window is a span."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import frames as W
from ..spec import SeriesSpec, no_zeros, window
from . import moments as M
from .metrics import roll_mad
from .moments import Value


def bollinger_band(df: DataFrame, spec: SeriesSpec, w: int | None = 20, n: float = 2.0, kind: str = "s", value: Value = None, out: str = "bollinger") -> DataFrame:
    """out_upper and out_lower: the moving average plus and minus n moving deviations of the same kind."""
    m, s = W.temporary(df, "m"), W.temporary(df, "s")
    df = M.moving_average(df, spec, w, kind, value, m)
    df = M.moving_deviation(df, spec, w, kind, value, s)
    return df.withColumn(f"{out}_upper", F.col(m) + n * F.col(s)).withColumn(f"{out}_lower", F.col(m) - n * F.col(s)).drop(m, s)


def cci(df: DataFrame, spec: SeriesSpec, high: str | None = None, low: str | None = None, w: int | None = 20, value: Value = None, out: str = "cci") -> DataFrame:
    """Commodity channel index: distance of the typical price from its average in mean absolute distances, over 0.015."""
    x = spec.x(value)
    p, m, d = (W.temporary(df, c) for c in ("p", "m", "d"))
    df = df.withColumn(p, (x + spec.x(high or value) + spec.x(low or value)) / 3)
    df = roll_mad(M.sma(df, spec, w, p, m), spec, w, p, d)
    return df.withColumn(out, (F.col(p) - F.col(m)) / F.when(F.col(d) == 0, 1.0).otherwise(F.col(d)) / 0.015).drop(p, m, d)


def hma(df: DataFrame, spec: SeriesSpec, w: int = 21, kind: str = "w", value: Value = None, out: str = "hma") -> DataFrame:
    """Hull average: the average over sqrt(w) of twice the average over w / 2 less that over w, all rounded down; w is 2 or more."""
    w = window(w, 2) or 21
    a, b = W.temporary(df, "half"), W.temporary(df, "full")
    df = M.moving_average(df, spec, w // 2, kind, value, a)
    df = M.moving_average(df, spec, w, kind, value, b)
    return M.moving_average(df, spec, int(w**0.5), kind, 2 * F.col(a) - F.col(b), out).drop(a, b)


def macd_line(df: DataFrame, spec: SeriesSpec, fast_w: int = 12, slow_w: int = 26, kind: str = "e", value: Value = None, out: str = "macd_line") -> DataFrame:
    """Fast moving average less slow one."""
    if not (fast_w and slow_w and fast_w > 0 and slow_w > 0):
        raise ValueError(f"windows {fast_w} and {slow_w} must be positive")
    a, b = W.temporary(df, "fast"), W.temporary(df, "slow")
    df = M.moving_average(df, spec, fast_w, kind, value, a)
    df = M.moving_average(df, spec, slow_w, kind, value, b)
    return df.withColumn(out, F.col(a) - F.col(b)).drop(a, b)


def signal_line(df: DataFrame, spec: SeriesSpec, w: int = 9, fast_w: int = 12, slow_w: int = 26, kind: str = "e", value: Value = None, out: str = "signal_line") -> DataFrame:
    """Moving average of the MACD line."""
    m = W.temporary(df, "macd")
    df = macd_line(df, spec, fast_w, slow_w, kind, value, m)
    return M.moving_average(df, spec, w, kind, m, out).drop(m)


def macd_hist(df: DataFrame, spec: SeriesSpec, w: int = 9, fast_w: int = 12, slow_w: int = 26, kind: str = "e", value: Value = None, out: str = "macd_hist") -> DataFrame:
    """MACD line less its signal line; the line is computed once."""
    m, s = W.temporary(df, "macd"), W.temporary(df, "signal")
    df = macd_line(df, spec, fast_w, slow_w, kind, value, m)
    df = M.moving_average(df, spec, w, kind, m, s)
    return df.withColumn(out, F.col(m) - F.col(s)).drop(m, s)


def rsi(df: DataFrame, spec: SeriesSpec, w: int | None = 14, kind: str = "e", value: Value = None, out: str = "rsi") -> DataFrame:
    """Relative strength index of log returns: 100 * up / (up + down + 1e-8), 0 at the first row, which enters no average."""
    x = spec.x(value)
    u, d, a, b = (W.temporary(df, c) for c in ("u", "d", "a", "b"))
    step = F.try_divide(no_zeros(x), F.lag(x).over(spec.by))
    change = F.ln(F.when(step > 0, step))
    df = df.withColumn(u, F.when(change.isNotNull(), F.greatest(change, F.lit(0.0)))).withColumn(d, F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0))))
    df = M.moving_average(df, spec, w, kind, u, a)
    df = M.moving_average(df, spec, w, kind, d, b)
    return df.withColumn(out, F.coalesce(100 * F.col(a) / (F.col(a) + F.col(b) + 1e-8), F.lit(0.0))).drop(u, d, a, b)


def iso_vol(df: DataFrame, spec: SeriesSpec, target_vol: float = 0.20, leverage: float = 1.0, period: float = 252, half_life: int = 11, value: Value = None, out: str = "iso_vol") -> DataFrame:
    """The coefficient that brings a series to the target volatility, at most leverage; 1 on the first two rows.

    The volatility is the exponential average (span half_life) of squared inverted returns, known one row late.
    """
    x = spec.x(value)
    r, v = W.temporary(df, "r2"), W.temporary(df, "vol")
    df = df.withColumn(r, F.pow(F.try_divide(F.lag(x).over(spec.by), x) - 1, 2))
    vol = F.sqrt(F.lit(float(period)) * W.exponential(F.col(r), spec, 1 - 2 / (1 + half_life)))
    df = df.withColumn(v, F.when(vol <= 0, 1e-8).otherwise(vol))
    known = F.lag(v).over(spec.by)
    return df.withColumn(out, F.least(F.coalesce(float(target_vol) / known, F.lit(1.0)), F.lit(float(leverage)))).drop(r, v)


