"""Portfolio allocation on long panels: covariances, weights over a whole panel, and walk-forward rebalancing."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import ship
from ..spec import SeriesSpec
from . import solvers
from .moments import Value


def _one(spec: SeriesSpec) -> tuple[str, str]:
    if len(spec.keys) != 1 or len(spec.order) != 1:
        raise ValueError("a panel has one key column and one order column")
    return spec.keys[0], spec.order[0]


def covariance(df: DataFrame, spec: SeriesSpec, ddof: int = 1, value: Value = None) -> DataFrame:
    """(a, b, n, cov, corr) for each pair of series with a <= b, over the rows that both have.

    The values of one order key are one array, so a panel of N series gives N (N + 1) / 2 pairs a row, summed map-side.
    """
    s, t = _one(spec)
    rows = df.select(F.col(t).alias("_t"), F.struct(F.col(s).alias("k"), spec.x(value).alias("x")).alias("v")).where("v.x is not null")
    each = rows.groupBy("_t").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    first = each.select(F.posexplode("vs").alias("i", "a"), "vs")
    pairs = first.select("a", F.explode(F.slice("vs", F.col("i") + 1, F.size("vs") - F.col("i"))).alias("b"))
    cov = F.covar_samp if ddof else F.covar_pop
    agg = pairs.groupBy(F.col("a.k").alias("a"), F.col("b.k").alias("b")).agg(F.count("*").alias("n"), cov("a.x", "b.x").alias("cov"), F.corr("a.x", "b.x").alias("corr"))
    return agg


def ivp_sql(df: DataFrame, spec: SeriesSpec, value: Value = None) -> DataFrame:
    """(key, weight): inverse-variance weights without bounds, in one aggregation."""
    s, _ = _one(spec)
    v = df.groupBy(s).agg((1 / F.var_samp(spec.x(value))).alias("_v"))
    return v.select(s, (F.col("_v") / F.sum("_v").over(Window.partitionBy())).alias("weight"))


def _matrix(pdf, ids: str = "s"):
    wide = pdf.pivot_table(index="rn", columns=ids, values="x", aggfunc="last", dropna=False)
    return wide.sort_index(axis=0).sort_index(axis=1)


def weights(df: DataFrame, spec: SeriesSpec, method: str | Callable = "ERC", by: str | None = None, value: Value = None, **options) -> DataFrame:
    """(by, key, weight) of one allocation over each panel: a row per series. Gaps are filled with the last value
    and rows before a series starts left out; with fewer than two rows all series weigh alike.

    Panels are told apart by the column by; each is solved in one task, which is bounded by its N series times T rows.
    """
    ship(df.sparkSession)
    s, t = _one(spec)
    solve = solvers.METHODS[method] if isinstance(method, str) else method
    rows = df.select((F.col(by) if by else F.lit(0)).cast("string").alias("g"), F.col(t).alias("rn"), F.col(s).cast("string").alias("s"), spec.x(value).alias("x"))

    def run(key, pdf):
        import pandas as pd

        m = _matrix(pdf).ffill().dropna()
        n = m.shape[1]
        w = np.ravel(solve(m.to_numpy(float), **options)) if n > 1 and len(m) > 1 else np.full(n, 1 / n)
        return pd.DataFrame({"g": key[0], "s": list(m.columns), "weight": w})

    out = rows.groupBy("g").applyInPandas(run, "g string, s string, weight double")
    names = ([F.col("g").alias(by)] if by else []) + [F.col("s").alias(s), "weight"]
    return out.select(*names)


def rolling_windows(dates: DataFrame, n: int, s: int) -> tuple[int, int]:
    """The number of rows and of windows: training ends before row n + k * s, while a row follows that one."""
    rows = dates.count()
    return rows, max(0, -(-(rows - 1 - n) // s))


def _windows(lo: Column, hi: Column, count: int) -> Column:
    """The windows from lo to hi, both included, as an array to explode."""
    a, b = F.greatest(lo, F.lit(0)), F.least(hi, F.lit(count - 1))
    return F.when(a <= b, F.sequence(a.cast("int"), b.cast("int"))).otherwise(F.array().cast("array<int>"))


def rolling_allocation(df: DataFrame, spec: SeriesSpec, method: str | Callable = "ERC", n: int = 252, s: int = 63, ret: bool = True, drift: bool = True, value: Value = None, **options) -> tuple[DataFrame, DataFrame]:
    """(portfolio, weights): every s rows, weights from the n rows before (returns if ret, else prices), held for s rows.

    portfolio is (order, portfolio), starting with 100 and chained over windows; weights is (win, order, key, weight), with
    the row that each window starts at. Gaps are filled with the last price; series constant for half of a window are left
    out of it. With drift, weights follow prices within a window, else each row rebalances. Windows are solved in parallel.
    """
    ship(df.sparkSession)
    key, order = _one(spec)
    solve = solvers.METHODS[method] if isinstance(method, str) else method
    dates = df.select(order).distinct().withColumn("rn", F.row_number().over(Window.orderBy(order)) - 1)
    total, count = rolling_windows(dates, n, s)
    by = Window.partitionBy("s").orderBy("rn")
    given = df.select(F.col(order), F.col(key).cast("string").alias("s"), spec.x(value).alias("x")).where("x is not null").join(dates, order).select("rn", "s", "x")
    until = F.coalesce(F.lead("rn").over(by), F.lit(total)) - 1
    panel = given.withColumn("until", until).select(F.explode(F.sequence("rn", "until")).alias("rn"), "s", "x")
    moved = panel.withColumn("r", F.try_divide("x", F.lag("x").over(by)) - 1 if ret else F.col("x"))
    last = F.floor(F.col("rn") / s)
    train = moved.withColumn("win", F.explode(_windows(F.ceil((F.col("rn") + 1 - n) / s), last, count)))

    def run(group, pdf):
        import pandas as pd

        wide = _matrix(pdf.assign(x=pdf["r"]))
        wide = wide.reindex(range(n + group[0] * s - n, n + group[0] * s))
        varied = wide.apply(lambda c: c.value_counts(dropna=False).max() < 0.5 * n)
        used = wide.loc[:, varied].bfill()
        if used.shape[1] == 0:
            return pd.DataFrame({"win": np.zeros(0, "int32"), "s": np.zeros(0, object), "weight": np.zeros(0)})
        w = np.ones(1) if used.shape[1] == 1 else np.ravel(solve(used.to_numpy(float), **options))
        return pd.DataFrame({"win": group[0], "s": list(used.columns), "weight": w})

    found = train.select("win", "rn", "s", "r", "x").groupBy("win").applyInPandas(run, "win int, s string, weight double")
    held = panel.withColumn("win", F.explode(_windows(F.ceil((F.col("rn") - n - s) / s), F.floor((F.col("rn") - n) / s), count)))
    held = held.join(found, ["win", "s"])
    inside = Window.partitionBy("win", "s").orderBy("rn")
    if drift:
        part = F.col("weight") * F.try_divide("x", F.first("x").over(inside))
        level = held.withColumn("p", part).groupBy("win", "rn").agg(F.sum("p").alias("level"))
    else:
        step = F.col("weight") * F.coalesce(F.try_divide("x", F.lag("x").over(inside)) - 1, F.lit(0.0))
        level = held.withColumn("p", step).groupBy("win", "rn").agg(F.sum("p").alias("q"))
        level = level.withColumn("level", F.product(1 + F.col("q")).over(Window.partitionBy("win").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)))
    ends = level.groupBy("win").agg(F.max_by("level", "rn").alias("end"))
    ends = ends.select("win", F.coalesce(F.product("end").over(Window.orderBy("win").rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0)).alias("base"))
    chained = level.join(ends, "win").where((F.col("rn") > n + F.col("win") * s) | (F.col("win") == 0)).select("rn", (100 * F.col("base") * F.col("level")).alias("portfolio"))
    portfolio = dates.join(chained, "rn", "left").select(order, F.coalesce("portfolio", F.lit(100.0)).alias("portfolio"))
    start = dates.select(F.col("rn").alias("_rn"), order)
    placed = found.join(start, F.col("win") * s + n == F.col("_rn")).select("win", order, F.col("s").alias(key), "weight")
    return portfolio, placed
