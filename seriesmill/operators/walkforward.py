"""Walk-forward models: training on a window, predicting what follows, rolling on; and ensembles of their predictions.

A model's weights go from window to window, so the windows of one model are one group and run in order; models and series
run in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import ship
from ..spec import SeriesSpec, check_kind
from .networks import LeastSquares, Perceptron, Recurrent

#: Makes a model with fit(x, y, batch_size, epochs) -> losses and predict(x), from (number of features, name of the model).
Factory = Callable[[int, str], object]


def perceptron(layers: Sequence[int] = (), **options) -> Factory:
    """Perceptrons that differ in their seeds, which follow from the models' names."""
    import zlib

    return lambda n, name: Perceptron(n, 1, tuple(layers), seed=zlib.crc32(name.encode()), **options)


def recurrent(kind: str = "gru", n_hidden: int = 8, **options) -> Factory:
    """Recurrent networks (rnn, gru or lstm) that differ in their seeds, which follow from the models' names."""
    import zlib

    return lambda n, name: Recurrent(kind, n, 1, n_hidden, seed=zlib.crc32(name.encode()), **options)


def least_squares() -> Factory:
    """Linear regressions."""
    return lambda n, name: LeastSquares()


def calendar(total: int, train: int, test: int, roll: int | None = None, start: int = 0, end: int | None = None) -> list[int]:
    """The rows at which windows are trained on the train rows before and tested on the test rows after."""
    roll, total = roll or test, total if end is None else min(total, end)
    at, out = max(train - roll, min(start, total - train - test)), []
    while at + roll + test <= total:
        at += roll
        if at >= train:
            out.append(at)
    return out


def walk_forward(df: DataFrame, spec: SeriesSpec, features: Sequence[str], factory: Factory, train: int = 252, test: int = 63, roll: int | None = None, batch_size: int = 64, epochs: int = 1, models: Sequence[str] = ("m0",), reset: int = 0, target: str | None = None, target_filter: Callable | None = None, start: int = 0, end: int | None = None) -> DataFrame:
    """(keys, model, order, win, part, y, pred, loss) with the rows that each window evaluates (the last roll rows that it
    trains on) and tests (the rows after them).

    target_filter changes targets before training (np.sign, say). reset starts a model's weights anew every so many windows,
    staggered over models. Rows with a NULL feature or target are left out; a series too short for a window gives no row.
    """
    ship(df.sparkSession)
    target = target or spec.value
    roll_ = roll or test
    names = list(models)
    rows = df.select(*spec.keys, *spec.order, *[F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(features)], F.col(target).cast("double").alias("_y")).dropna()
    rows = rows.withColumn("model", F.explode(F.array(*[F.lit(m) for m in names])))
    head = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (*spec.keys, *spec.order))
    columns = [*spec.keys, *spec.order]

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(list(spec.order), ignore_index=True)
        name = pdf["model"].iloc[0]
        x = pdf[[f"_f{i}" for i in range(len(features))]].to_numpy(float)
        y = pdf["_y"].to_numpy(float)
        goal = target_filter(y) if target_filter else y
        net, out = factory(x.shape[1], name), []
        for win, t in enumerate(calendar(len(y), train, test, roll_, start, end)):
            if reset and win and (win + names.index(name) * max(1, reset // len(names))) % reset == 0:
                net = factory(x.shape[1], name)
            loss = net.fit(x[t - train : t], goal[t - train : t], batch_size=batch_size, epochs=epochs)
            for part, lo, hi in (("eval", t - roll_, t), ("test", t, min(t + test, len(y)))):
                block = pdf.loc[lo : hi - 1, columns].copy()
                block["model"], block["win"], block["part"], block["y"] = name, win, part, y[lo:hi]
                block["pred"], block["loss"] = np.ravel(net.predict(x[lo:hi])), float(np.ravel(loss)[-1])
                out.append(block)
        names_out = [*columns, "model", "win", "part", "y", "pred", "loss"]
        if not out:
            kinds = {"win": "int32", "part": object, "y": float, "pred": float, "loss": float}
            return pdf.iloc[:0][[*columns, "model"]].assign(**{c: np.zeros(0, k) for c, k in kinds.items()})[names_out]
        return pd.concat(out)[names_out]

    return rows.groupBy(*spec.keys, "model").applyInPandas(run, f"{head}, model string, win int, part string, y double, pred double, loss double")


def losses(predictions: DataFrame, spec: SeriesSpec) -> DataFrame:
    """(keys, model, win, train, eval, test): the training loss and the mean squared errors of each window."""
    error = lambda part: F.avg(F.when(F.col("part") == part, F.pow(F.col("pred") - F.col("y"), 2)))
    return predictions.groupBy(*spec.keys, "model", "win").agg(F.first("loss").alias("train"), error("eval").alias("eval"), error("test").alias("test"))


def performance(predictions: DataFrame, spec: SeriesSpec, base: float = 100.0, log: bool = True, by: Sequence[str] = ("model",)) -> DataFrame:
    """Tested rows with perf: base compounded over the sign of the prediction times the return y."""
    w = Window.partitionBy(*spec.keys, *by).orderBy(*spec.order).rowsBetween(Window.unboundedPreceding, 0)
    gain = F.signum("pred") * F.col("y")
    level = F.exp(F.sum(gain).over(w)) if log else F.product(1 + gain).over(w)
    return predictions.where("part = 'test'").withColumn("perf", base * level)


def ensemble(predictions: DataFrame, spec: SeriesSpec, how: str = "mean", top: int = 3) -> DataFrame:
    """(keys, order, y, pred) of tested rows over models: mean, sum, best (the model of greatest performance until the row
    before) or bests (the mean of the top of them; all of them if there are fewer)."""
    how = check_kind(how, ("mean", "sum", "best", "bests"))
    rows = performance(predictions, spec)
    at = [*spec.keys, *spec.order]
    if how in ("mean", "sum"):
        return rows.groupBy(*at).agg(F.first("y").alias("y"), (F.avg("pred") if how == "mean" else F.sum("pred")).alias("pred"))
    known = F.coalesce(F.lag("perf").over(Window.partitionBy(*spec.keys, "model").orderBy(*spec.order)), F.lit(100.0))
    ranked = rows.withColumn("_known", known).withColumn("_rank", F.row_number().over(Window.partitionBy(*at).orderBy(F.col("_known").desc(), "model")))
    return ranked.where(F.col("_rank") <= (1 if how == "best" else top)).groupBy(*at).agg(F.first("y").alias("y"), F.avg("pred").alias("pred"))


def batches(df: DataFrame, spec: SeriesSpec, start: int = 0, end: int | None = None, step: int = 1, shuffle: bool = False, seed: int = 0, out: str = "batch") -> DataFrame:
    """Rows from start to end of each series with the number of their batch of step rows, in order or shuffled."""
    order = F.row_number().over(spec.by) - 1
    rows = df.withColumn("_rn", order).where((F.col("_rn") >= start) & (F.lit(True) if end is None else F.col("_rn") < end))
    place: Column = F.col("_rn") - start
    if shuffle:
        mixed = Window.partitionBy(*spec.keys).orderBy(F.xxhash64("_rn", F.lit(seed)), "_rn")
        place = F.row_number().over(mixed) - 1
    return rows.withColumn(out, F.floor(place / step).cast("int")).drop("_rn")
