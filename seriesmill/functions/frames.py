"""Rolling and exponential expressions. Rows whose value is NULL are in no frame; NaN goes through arithmetic.

Frames hold rows: the last w with the current one, fewer at the start, so results are never NULL for want of rows.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..spec import SeriesSpec, check_ddof, window

#: Sliding frames are recomputed for each row; sums over longer ones come from two growing frames, which cost one step a row.
LONG = 256


_numbers = itertools.count()


def temporary(df: DataFrame, name: str) -> str:
    """A column name that neither df nor any operator around has."""
    while True:
        found = f"_{name}_{next(_numbers)}"
        if found not in df.columns:
            return found


def count(x: Column, spec: SeriesSpec, w: int | None) -> Column:
    return F.count(x).over(spec.last(w))


def _moving(x: Column, spec: SeriesSpec, w: int) -> Column:
    """The sum over a long frame as the difference of two growing ones; x must be finite or NULL."""
    gone = F.sum(x).over(spec.by.rowsBetween(Window.unboundedPreceding, -w))
    return F.sum(x).over(spec.expanding) - F.coalesce(gone, F.lit(0.0))


def total(x: Column, spec: SeriesSpec, w: int | None) -> Column:
    """The sum over the frame, of whatever length: values that aren't finite count in the frames that hold them alone."""
    w = window(w)
    if w is None or w <= LONG:
        return F.sum(x).over(spec.last(w))
    x = x.cast("double")
    up, down = x == float("inf"), x == float("-inf")
    finite = F.when(F.isnan(x) | up | down, 0.0).otherwise(x)
    held = lambda odd: _moving(F.when(odd, 1.0).when(x.isNotNull(), 0.0), spec, w) > 0.5
    ups, downs = held(up), held(down)
    odd = F.when(held(F.isnan(x)) | (ups & downs), F.lit(float("nan"))).when(ups, F.lit(float("inf"))).when(downs, F.lit(float("-inf")))
    return F.when(count(x, spec, w) > 0, F.coalesce(odd, _moving(finite, spec, w)))


def mean(x: Column, spec: SeriesSpec, w: int | None) -> Column:
    w = window(w)
    return F.avg(x).over(spec.last(w)) if w is None or w <= LONG else F.try_divide(total(x, spec, w), count(x, spec, w))


def deviation(x: Column, spec: SeriesSpec, w: int | None, ddof: int = 0) -> Column:
    """The standard deviation over the frame, 0 where it has no more than ddof values."""
    w = window(w)
    check_ddof(ddof, w)
    k = count(x, spec, w)
    if w is None or w <= LONG:
        pop = F.stddev_pop(x).over(spec.last(w))
    else:
        centre = F.first(F.when(F.abs(x) < float("inf"), x), ignorenulls=True).over(spec.whole.orderBy(*spec.order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        y = x - centre
        m = F.try_divide(total(y, spec, w), k)
        pop = F.sqrt(F.greatest(F.try_divide(total(y * y, spec, w), k) - m * m, F.lit(0.0)))
    return F.when(k <= ddof, F.lit(0.0)).otherwise(pop * F.sqrt(F.try_divide(k.cast("double"), k - ddof)))


def minimum(x: Column, spec: SeriesSpec, w: int | None) -> Column:
    return F.min(x).over(spec.last(w))


def maximum(x: Column, spec: SeriesSpec, w: int | None) -> Column:
    return F.max(x).over(spec.last(w))


def values(x: Column, spec: SeriesSpec, w: int | None) -> Column:
    """The frame as an array, oldest first."""
    return F.collect_list(x).over(spec.last(w))


def added(array: Column, f) -> Column:
    """The sum of f(value, place from 0) over an array of doubles."""
    return F.aggregate(F.transform(array, f), F.lit(0.0), lambda a, v: a + v)


def linear_sums(df: DataFrame, x: Column, spec: SeriesSpec, w: int | None) -> tuple[DataFrame, Column, Column, list[str]]:
    """The sums of x and of x squared, each weighted 1, 2, ... from the oldest value of the frame; and columns to drop."""
    w = window(w)
    if w is not None and w <= LONG:
        a = temporary(df, "frame")
        df = df.withColumn(a, values(x, spec, w))
        return df, added(F.col(a), lambda v, i: (i + 1) * v), added(F.col(a), lambda v, i: (i + 1) * v * v), [a]
    n = temporary(df, "ordinal")
    df = df.withColumn(n, F.count(x).over(spec.expanding).cast("double"))
    k, i = count(x, spec, w), F.col(n)
    weighted = lambda y: total(i * y, spec, w) - (i - k) * total(y, spec, w)
    return df, weighted(x), weighted(x * x), [n]


def exponential(x: Column, spec: SeriesSpec, decay: float) -> Column:
    """e_0 = x_0, e_t = decay * e_(t-1) + (1 - decay) * x_t over the values that aren't NULL.

    Spark's exponential window expression divides by the weights given so far, 1 - decay^n; multiplied out, what is missing
    is the first value with the weight decay^n.
    """
    if not 0 <= decay <= 1:
        raise ValueError(f"decay {decay} must be between 0 and 1")
    first = F.first(x, ignorenulls=True).over(spec.expanding)
    if decay == 0:
        return F.last(x, ignorenulls=True).over(spec.expanding)
    if decay == 1:
        return first
    try:
        from pyspark.sql.internal import InternalFunction
    except ImportError:  # not a public name: without it, a fold over the values so far, which takes more time for long series
        so_far = values(x, spec, None)
        fold = F.aggregate(F.slice(so_far, F.lit(2), F.greatest(F.size(so_far) - 1, F.lit(0))), F.get(so_far, F.lit(0)), lambda a, v: float(decay) * a + float(1 - decay) * v)
        return F.when(F.size(so_far) > 0, fold)
    rest = F.pow(F.lit(float(decay)), F.count(x).over(spec.expanding).cast("double"))
    return InternalFunction.ewm(x, 1.0 - decay, True).over(spec.by) * (1 - rest) + rest * first
