"""Moving averages, deviations and extremes; w None means all rows so far. Each adds one double column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import frames as W
from ..spec import SeriesSpec, check_kind, decay

Value = Column | str | None


def sma(df: DataFrame, spec: SeriesSpec, w: int | None = None, value: Value = None, out: str = "sma") -> DataFrame:
    """Simple moving average."""
    return df.withColumn(out, W.mean(spec.x(value), spec, w))


def wma(df: DataFrame, spec: SeriesSpec, w: int | None = None, value: Value = None, out: str = "wma") -> DataFrame:
    """Linearly weighted moving average, the newest value weighing most."""
    x = spec.x(value)
    df, first, _, drop = W.linear_sums(df, x, spec, w)
    k = W.count(x, spec, w)
    return df.withColumn(out, F.try_divide(first, k * (k + 1) / 2)).drop(*drop)


def _decay(alpha: float, w: int | None) -> float:
    return decay(w) if w is not None else alpha


def ema(df: DataFrame, spec: SeriesSpec, alpha: float = 0.94, w: int | None = None, value: Value = None, out: str = "ema") -> DataFrame:
    """Exponential moving average with decay alpha, or with the decay of span w."""
    return df.withColumn(out, W.exponential(spec.x(value), spec, _decay(alpha, w)))


def smstd(df: DataFrame, spec: SeriesSpec, w: int | None = None, ddof: int = 0, value: Value = None, out: str = "smstd") -> DataFrame:
    """Simple moving standard deviation; 0 while the frame has no more than ddof values."""
    return df.withColumn(out, W.deviation(spec.x(value), spec, w, ddof))


def wmstd(df: DataFrame, spec: SeriesSpec, w: int | None = None, value: Value = None, out: str = "wmstd") -> DataFrame:
    """Standard deviation with the weights of wma."""
    x = spec.x(value)
    df, first, second, drop = W.linear_sums(df, x, spec, w)
    k = W.count(x, spec, w)
    m = k * (k + 1) / 2
    a, b = F.try_divide(first, m), F.try_divide(second, m)
    return df.withColumn(out, F.sqrt(F.greatest(b - a * a, F.lit(0.0)))).drop(*drop)


def emstd(df: DataFrame, spec: SeriesSpec, alpha: float = 0.94, w: int | None = None, value: Value = None, out: str = "emstd") -> DataFrame:
    """Root of the exponential average of squared distances from the exponential average."""
    x, lam = spec.x(value), _decay(alpha, w)
    m = W.temporary(df, "centre")
    df = df.withColumn(m, W.exponential(x, spec, lam))
    return df.withColumn(out, F.sqrt(W.exponential(F.pow(x - F.col(m), 2), spec, lam))).drop(m)


def roll_min(df: DataFrame, spec: SeriesSpec, w: int | None = None, value: Value = None, out: str = "roll_min") -> DataFrame:
    """Least value of the frame."""
    return df.withColumn(out, W.minimum(spec.x(value), spec, w))


def roll_max(df: DataFrame, spec: SeriesSpec, w: int | None = None, value: Value = None, out: str = "roll_max") -> DataFrame:
    """Greatest value of the frame."""
    return df.withColumn(out, W.maximum(spec.x(value), spec, w))


def moving_average(df: DataFrame, spec: SeriesSpec, w: int | None, kind: str, value: Value = None, out: str = "ma") -> DataFrame:
    """sma, wma or ema by kind s, w or e; for e, w is a span."""
    kind = check_kind(kind, "swe")
    if kind == "e":
        return ema(df, spec, w=w, value=value, out=out)
    return (sma if kind == "s" else wma)(df, spec, w, value, out)


def moving_deviation(df: DataFrame, spec: SeriesSpec, w: int | None, kind: str, value: Value = None, out: str = "std") -> DataFrame:
    """smstd, wmstd or emstd by kind s, w or e; for e, w is a span."""
    kind = check_kind(kind, "swe")
    if kind == "e":
        return emstd(df, spec, w=w, value=value, out=out)
    return smstd(df, spec, w, 0, value, out) if kind == "s" else wmstd(df, spec, w, value, out)


def ffill(df: DataFrame, spec: SeriesSpec, value: Value = None, out: str = "ffill") -> DataFrame:
    """The last value so far that isn't NULL."""
    return df.withColumn(out, F.last(spec.x(value), ignorenulls=True).over(spec.expanding))


def bfill(df: DataFrame, spec: SeriesSpec, value: Value = None, out: str = "bfill") -> DataFrame:
    """The next value that isn't NULL.

    It is the last so far in descending order: a frame that grows costs one step a row, one that shrinks is folded anew for each.
    """
    return df.withColumn(out, F.last(spec.x(value), ignorenulls=True).over(spec.falling.rowsBetween(Window.unboundedPreceding, 0)))


def lags(df: DataFrame, spec: SeriesSpec, k: int, value: Value = None, out: str = "lag") -> DataFrame:
    """Columns out_1 to out_k: the values so many rows before, 0 before the first."""
    from ..spec import check_lags

    for i in range(1, check_lags(k) + 1):
        df = df.withColumn(f"{out}_{i}", F.coalesce(F.lag(spec.x(value), i).over(spec.by), F.lit(0.0)))
    return df


def dead_zone_sign(df: DataFrame, spec: SeriesSpec, alpha: float = 0.05, value: Value = None, out: str = "sign") -> DataFrame:
    """The sign of a value, 0 within alpha of zero."""
    x = spec.x(value)
    return df.withColumn(out, F.when(F.abs(x) < alpha, 0.0).otherwise(F.signum(x)))


def signal(df: DataFrame, spec: SeriesSpec, pred: str = "sign", value: Value = None, out: str = "signal") -> DataFrame:
    """A position from a prediction: its sign, or for probabilities -1 below one half and 1 from there."""
    x = spec.x(value)
    kind = check_kind(pred, ("sign", "prob"))
    return df.withColumn(out, F.signum(x) if kind == "sign" else F.when(x < 0.5, -1.0).otherwise(1.0))
