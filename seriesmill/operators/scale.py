"""Scaling, with parameters per series or per frame, and its exact inverse."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import frames as W
from ..spec import SeriesSpec, check_kind
from . import moments as M
from .moments import Value

KINDS = ("raw", "norm", "std", "roll_norm", "roll_std")


def standardize(df: DataFrame, spec: SeriesSpec, a: float = 0.0, b: float = 1.0, value: Value = None, out: str = "standardize") -> DataFrame:
    """b * (x - mean) / deviation + a over the whole series; NULL where it is constant."""
    x = spec.x(value)
    return df.withColumn(out, float(b) * F.try_divide(x - F.avg(x).over(spec.whole), F.stddev_pop(x).over(spec.whole)) + float(a))


def normalize(df: DataFrame, spec: SeriesSpec, a: float = 0.0, b: float = 1.0, value: Value = None, out: str = "normalize") -> DataFrame:
    """The series brought to the range from a to b; NULL where it is constant."""
    x = spec.x(value)
    low, high = F.min(x).over(spec.whole), F.max(x).over(spec.whole)
    return df.withColumn(out, float(b - a) * F.try_divide(x - low, high - low) + float(a))


def roll_standardize(df: DataFrame, spec: SeriesSpec, w: int | None = None, a: float = 0.0, b: float = 1.0, kind_moment: str = "s", value: Value = None, out: str = "roll_standardize") -> DataFrame:
    """standardize by moving average and deviation of a kind; NULL where the deviation is 0, as on the first row."""
    x, m, s = spec.x(value), W.temporary(df, "m"), W.temporary(df, "s")
    df = M.moving_average(df, spec, w, kind_moment, value, m)
    df = M.moving_deviation(df, spec, w, kind_moment, value, s)
    return df.withColumn(out, float(b) * F.try_divide(x - F.col(m), F.col(s)) + float(a)).drop(m, s)


def roll_normalize(df: DataFrame, spec: SeriesSpec, w: int | None = None, a: float = 0.0, b: float = 1.0, value: Value = None, out: str = "roll_normalize") -> DataFrame:
    """normalize by the frame's least and greatest value; NULL where they are equal, as on the first row."""
    x = spec.x(value)
    low, high = W.minimum(x, spec, w), W.maximum(x, spec, w)
    return df.withColumn(out, float(b - a) * F.try_divide(x - low, high - low) + float(a))


@dataclass(frozen=True)
class Scale:
    """An estimator: fit learns the parameters of each series, or for rolling kinds of each row."""

    kind: str = "std"
    a: float = 0.0
    b: float = 1.0
    w: int | None = None
    kind_moment: str = "s"

    def fit(self, df: DataFrame, spec: SeriesSpec, value: Value = None) -> ScaleModel:
        kind = check_kind(self.kind, KINDS)
        x = spec.x(value)
        if kind == "raw":
            return ScaleModel(self, spec, None, ())
        if kind in ("norm", "std"):
            centre, spread = (F.min(x), F.max(x) - F.min(x)) if kind == "norm" else (F.avg(x), F.stddev_pop(x))
            return ScaleModel(self, spec, df.groupBy(*spec.keys).agg(centre.alias("_scale_m"), spread.alias("_scale_s")), spec.keys)
        if kind == "roll_norm":
            low, high = W.minimum(x, spec, self.w), W.maximum(x, spec, self.w)
            rows = df.withColumn("_scale_m", F.when(low == high, 0.0).otherwise(low)).withColumn("_scale_s", F.when(low == high, 2 * high).otherwise(high - low))
        else:
            rows = M.moving_average(df, spec, self.w, self.kind_moment, value, "_scale_m")
            rows = M.moving_deviation(rows, spec, self.w, self.kind_moment, value, "_scale_s")
            rows = rows.withColumn("_scale_s", F.when(F.col("_scale_s") == 0, 1.0).otherwise(F.col("_scale_s")))
        return ScaleModel(self, spec, rows.select(*spec.keys, *spec.order, "_scale_m", "_scale_s"), (*spec.keys, *spec.order))


@dataclass(frozen=True)
class ScaleModel:
    """Fitted parameters (centre _scale_m, spread _scale_s) by series, or by row for rolling kinds."""

    settings: Scale
    spec: SeriesSpec
    params: DataFrame | None
    on: tuple[str, ...]

    def _with(self, df: DataFrame, f, out: str) -> DataFrame:
        if self.params is None:
            return df.withColumn(out, self.spec.x())
        return df.join(self.params, list(self.on), "left").withColumn(out, f(F.col("_scale_m"), F.col("_scale_s"))).drop("_scale_m", "_scale_s")

    def _width(self) -> tuple[float, float]:
        a, b = float(self.settings.a), float(self.settings.b)
        return (a, b - a) if self.settings.kind.lower() in ("norm", "roll_norm") else (a, b)

    def scale(self, df: DataFrame, value: Value = None, out: str = "scaled") -> DataFrame:
        """out = width * (x - m) / s + a."""
        a, width = self._width()

        def scaled(m: Column, s: Column) -> Column:
            return width * F.try_divide(self.spec.x(value) - m, s) + a

        return self._with(df, scaled, out)

    def revert(self, df: DataFrame, value: Value, out: str = "reverted") -> DataFrame:
        """The inverse of scale."""
        a, width = self._width()
        x = self.spec.x(value)
        return self._with(df, lambda m, s: (x - a) * s / width + m, out) if self.params is not None else df.withColumn(out, x)

    transform, inverse_transform = scale, revert
