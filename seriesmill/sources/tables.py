"""Reading series in long form, turning wide tables long, and keeping models and losses as tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, format: str = "parquet", columns: Sequence[str] | None = None, **options) -> DataFrame:
    """A table of any format that Spark reads, with only the columns asked for."""
    df = spark.read.format(format).options(**options).load(path)
    return df.select(*columns) if columns else df


def from_wide(df: DataFrame, order: str | Sequence[str], columns: Sequence[str], key: str = "s", value: str = "x", dropna: bool = True) -> DataFrame:
    """(order, key, value) from a table with a column per series."""
    order = [order] if isinstance(order, str) else list(order)
    long = df.select(*order, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(order, list(columns), key, value)
    return long.where(F.col(value).isNotNull()) if dropna else long


def to_wide(df: DataFrame, order: str, key: str = "s", value: str = "x", keys: Sequence | None = None) -> DataFrame:
    """A column per series from (order, key, value); naming the keys saves the pass that finds them."""
    grouped = df.groupBy(order)
    return (grouped.pivot(key, list(keys)) if keys else grouped.pivot(key)).agg(F.first(value))


def append(df: DataFrame, more: DataFrame) -> DataFrame:
    """Rows of both, by column name."""
    return df.unionByName(more)


def vector(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """The columns as one array of doubles; NULL if any is."""
    values = [F.col(c).cast("double") for c in columns]
    whole = F.lit(True)
    for v in values:
        whole = whole & v.isNotNull()
    return df.withColumn(out, F.when(whole, F.array(*values)))


def save_models(models: dict[str, str], spark: SparkSession, path: str) -> None:
    """Named models (as JSON) to a Parquet table."""
    spark.createDataFrame(sorted(models.items()), "name string, model string").write.mode("overwrite").parquet(path)


def load_models(spark: SparkSession, path: str) -> dict[str, str]:
    return {r["name"]: r["model"] for r in spark.read.parquet(path).collect()}


def log_losses(losses: DataFrame, path: str) -> None:
    """Appends losses to a table that grows by it."""
    losses.write.mode("append").parquet(path)


def autoregressive(spark: SparkSession, series: int, length: int, phi: Sequence[float] | Callable[[int], Sequence[float]], noise: float = 0.01, seed: int = 0) -> DataFrame:
    """(s, t, x): synthetic autoregressive series, each made in its own group; phi may give the coefficients at each t."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        s = int(pdf["s"].iloc[0])
        e = np.random.default_rng([seed, s]).normal(0, noise, length)
        x = np.zeros(length)
        for t in range(length):
            now = phi(t) if callable(phi) else phi
            k = min(t, len(now))
            x[t] = e[t] + (np.dot(x[t - k : t][::-1], now[:k]) if k else 0.0)
        return pd.DataFrame({"s": s, "t": np.arange(length), "x": x})

    return spark.range(series).withColumnRenamed("id", "s").groupBy("s").applyInPandas(run, "s long, t long, x double")
