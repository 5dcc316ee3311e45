"""Running values of a series over a stream: the state of a key is a few doubles, however long the series is.

Within a micro-batch rows are taken in the order of their time; rows of later batches follow. Late rows, below the time of
the last row taken, are dropped, since a recursion can't go back.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import ship

OUT = "key string, t double, x double, ema double, emstd double, peak double, drawdown double, n long"
STATE = "t double, ema double, var double, peak double, n long"


def running(stream: DataFrame, key: str, time: str, value: str, alpha: float = 0.94) -> DataFrame:
    """OUT for each row of a stream: exponential average and deviation (decay alpha), greatest value, drawdown and count."""
    ship(stream.sparkSession)
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(time).cast("double").alias("t"), F.col(value).cast("double").alias("x")).where("x is not null and t is not null")

    def update(group: tuple, frames: Iterator, state) -> Iterator:
        import pandas as pd

        last, ema, var, peak, n = state.get if state.exists else (float("-inf"), 0.0, 0.0, float("-inf"), 0)
        parts = list(frames)
        pdf = pd.concat(parts).sort_values("t", kind="stable") if parts else pd.DataFrame({"t": [], "x": []})
        out = []
        for t, x in zip(pdf["t"], pdf["x"], strict=True):
            if t < last:
                continue
            ema = x if n == 0 else alpha * ema + (1 - alpha) * x
            var = 0.0 if n == 0 else alpha * var + (1 - alpha) * (x - ema) ** 2
            peak, last, n = max(peak, x), t, n + 1
            out.append((group[0], t, x, ema, var**0.5, peak, 1 - x / peak if peak else None, n))
        state.update((last, ema, var, peak, n))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    return rows.groupBy("key").applyInPandasWithState(update, OUT, STATE, "append", "NoTimeout")


def windowed(stream: DataFrame, key: str, time: str, value: str, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Open, high, low, close and count of tumbling windows, with a watermark."""
    w = F.window(F.col(time).cast("timestamp"), length).alias("w")
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    agg = rows.groupBy(w, F.col(key).alias("key")).agg(F.min_by(value, time).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, time).alias("close"), F.count(value).alias("n"))
    return agg.select("key", F.col("w.start").alias("start"), "open", "high", "low", "close", "n")
