"""What a series is: key columns, an order column (unique within a key, or with tie-breakers) and the frames over them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


class ArraySizeError(ValueError, IndexError):
    """A series is shorter than an operator needs."""

    def __init__(self, size: int, axis: int | None = None, min_size: int | None = None, msg_prefix: str = ""):
        self.size, self.axis, self.min_size = size, axis, min_size
        text = f"{msg_prefix + ': ' if msg_prefix else ''}array size of {size} is not allowed"
        if axis is not None:
            text += f" along axis {axis}"
        if min_size is not None:
            text += f", minimum size is {min_size}"
        super().__init__(text)


@dataclass(frozen=True)
class SeriesSpec:
    """keys partition the table into series, order sorts each, value is the default value column.

    A table that is wide in series is long here: each series is a key. Looking along the other axis of a panel means to
    swap keys and order.
    """

    keys: tuple[str, ...]
    order: tuple[str, ...]
    value: str = "x"

    @staticmethod
    def of(keys: str | Sequence[str], order: str | Sequence[str], value: str = "x") -> SeriesSpec:
        as_tuple = lambda v: (v,) if isinstance(v, str) else tuple(v)
        return SeriesSpec(as_tuple(keys), as_tuple(order), value)

    @property
    def by(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    @property
    def falling(self) -> WindowSpec:
        """by, from the last row to the first; nulls in order columns are first in by, so they are last here."""
        return Window.partitionBy(*self.keys).orderBy(*[F.col(c).desc_nulls_last() for c in self.order])

    @property
    def whole(self) -> WindowSpec:
        """All rows of the series."""
        return Window.partitionBy(*self.keys)

    @property
    def expanding(self) -> WindowSpec:
        """From the first row to the current one."""
        return self.by.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def last(self, w: int | None) -> WindowSpec:
        """The last w rows with the current one, fewer at the start; all so far if w is None or 0."""
        w = window(w)
        return self.expanding if w is None else self.by.rowsBetween(-(w - 1), Window.currentRow)

    def swapped(self) -> SeriesSpec:
        """The panel along its other axis."""
        return SeriesSpec(self.order, self.keys, self.value)

    def x(self, value: Column | str | None = None) -> Column:
        """The value as a double."""
        col = self.value if value is None else value
        return (F.col(col) if isinstance(col, str) else col).cast("double")


def window(w: int | None, least: int = 1) -> int | None:
    """A window length, None meaning all rows so far."""
    if not w:
        return None
    if w < 0:
        raise ValueError(f"window {w} must be positive")
    if w < least:
        raise ValueError(f"window {w} must be {least} or more")
    return int(w)


def decay(w: int) -> float:
    """The decay of an exponential average whose span is w."""
    if w is None or w <= 0:
        raise ValueError(f"span {w} must be positive")
    return 1 - 2 / (1 + w)


def check_ddof(ddof: int, w: int | None = None) -> int:
    if ddof < 0:
        raise ValueError(f"ddof {ddof} must not be negative")
    if w and ddof >= w:
        raise ValueError(f"ddof {ddof} must be less than the window {w}")
    return ddof


def check_lags(k: int) -> int:
    if k <= 0:
        raise ValueError(f"lag {k} must be greater than 0")
    return k


def check_kind(kind: str, allowed: Sequence[str]) -> str:
    kind = kind.lower()
    if kind not in allowed:
        raise ValueError(f"unknown kind {kind!r}; use one of {', '.join(allowed)}")
    return kind


def no_zeros(x: Column, validate: bool = True) -> Column:
    """x, raising where it is zero; unchecked if validate is False."""
    return F.when(x == 0, F.raise_error(F.lit("null value: the series must not contain zeros")).cast("double")).otherwise(x) if validate else x


def check_size(df: DataFrame, spec: SeriesSpec, min_size: int) -> DataFrame:
    """df, after an eager check that no series is shorter than min_size."""
    short = df.where(F.col(spec.value).isNotNull()).groupBy(*spec.keys).count().agg(F.min("count")).first()[0]
    if short is not None and short < min_size:
        raise ArraySizeError(short, axis=0, min_size=min_size)
    return df
