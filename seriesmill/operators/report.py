"""Backtest reports: the curves and key figures of a strategy, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import frames as W
from ..spec import SeriesSpec
from . import indicators as I
from . import metrics as X


def backtest(df: DataFrame, spec: SeriesSpec, signal: str, period: float = 252, fee: float = 0.0, win: int = 252, target_vol: float = 0.20, leverage: float = 1.0, half_life: int = 11, log_returns: str | None = None) -> DataFrame:
    """Underlying, strategy and volatility-scaled strategy: columns perf_*, drawdown_* and sharpe_* for idx, est and iso.

    The value column is a price, from which log returns are taken, unless log_returns names them. All windows share the
    series' partitioning and order, so the plan has one exchange.
    """
    r = log_returns or W.temporary(df, "r")
    df = df if log_returns else X.returns(df, spec, True, None, r)
    df = X.perf_signal(df.withColumn("_one", F.lit(1.0)), spec, "_one", r, 100.0, True, "perf_idx")
    df = X.perf_fees(df, spec, signal, fee, r, False, 100.0, "perf_est")
    df = I.iso_vol(df, spec, target_vol, leverage, period, half_life, "perf_idx", "iso_coef")
    df = df.withColumn("_iso", F.col("iso_coef") * F.col(signal))
    df = X.perf_fees(df, spec, "_iso", fee, r, False, 100.0, "perf_iso")
    for name in ("idx", "est", "iso"):
        df = X.drawdown(df, spec, False, f"perf_{name}", f"drawdown_{name}")
        df = X.roll_sharpe(df, spec, 0.0, period, win, True, 0, f"perf_{name}", f"sharpe_{name}")
    return df.drop("_one", "_iso", *([] if log_returns else [r]))


def figures(df: DataFrame, spec: SeriesSpec, signals: dict[str, str], period: float = 252, fee: float = 0.0) -> DataFrame:
    """(keys, strategy, metric, value): accuracy, annual performance, volatility, Sharpe and Calmar ratio of each strategy.

    signals maps a strategy's name to its signal column; the underlying is held as well. Volatility leaves out the first row.
    """
    r = W.temporary(df, "r")
    base = X.returns(df, spec, True, None, r).withColumn("_one", F.lit(1.0))
    parts = []
    for name, s in {"underlying": "_one", **signals}.items():
        one = X.perf_fees(base, spec, s, fee if s != "_one" else 0.0, r, False, 100.0, "_p")
        one = X.drawdown(one, spec, False, "_p", "_d")
        one = one.withColumn("_q", F.lag("_p").over(spec.by)).withColumn("_c", F.try_divide(F.col("_p"), F.col("_q")) - 1)
        t = F.struct(*spec.order)
        growth = F.pow(F.try_divide(F.max_by("_p", t), F.min_by("_p", t)), F.try_divide(F.lit(float(period)), F.count("_p"))) - 1
        right = F.avg((F.signum(r) == F.signum(F.col(s).cast("double"))).cast("double"))
        vol = F.sqrt(F.lit(float(period))) * F.stddev_pop("_c")
        agg = one.groupBy(*spec.keys).agg(right.alias("accuracy"), growth.alias("perf"), vol.alias("vol"), F.max("_d").alias("_m"))
        agg = agg.withColumn("sharpe", F.when(F.col("vol") == 0, 0.0).otherwise(F.try_divide("perf", "vol"))).withColumn("calmar", F.when(F.col("_m") == 0, 0.0).otherwise(F.try_divide("perf", "_m")))
        parts.append(agg.withColumn("strategy", F.lit(name)).unpivot([*spec.keys, "strategy"], ["accuracy", "perf", "vol", "sharpe", "calmar"], "metric", "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def text_report(kpi: DataFrame) -> str:
    """A small figures table as text."""
    rows = kpi.orderBy(*kpi.columns[:-1]).toPandas()
    return rows.to_string(index=False, float_format=lambda v: f"{v:.4f}")
