"""Rolling operators on blocks of long series.

A series is one task in a window over its key, whatever its length. Here rows are range-partitioned by key and order, so that
a long series spreads over many blocks; each block also gets the rows before it that its first frames reach back to, and the
operator runs with the block as one more key. So it does for every operator whose value depends on the last rows only:
frames of w rows, and exponential averages, whose older rows weigh less than a double can tell.

What depends on all rows so far through a greatest, least or first value, a sum, a product or a count is carried from block
to block: each block is folded to one row, those few rows are folded along the series, and a block starts from what is before.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import materialize
from ..functions.frames import temporary
from ..spec import SeriesSpec, check_kind
from . import metrics as X
from .moments import Value


def reach(decay: float, precision: float = 1e-17) -> int:
    """The rows after which an exponential average with this decay has forgotten what was before."""
    if not 0 < decay < 1:
        raise ValueError(f"decay {decay} must be between 0 and 1")
    return math.ceil(math.log(precision) / math.log(decay)) + 1


def blocked(df: DataFrame, spec: SeriesSpec, w: int, operator: Callable[[DataFrame, SeriesSpec], DataFrame], blocks: int | None = None) -> DataFrame:
    """operator(df, spec), computed on about so many blocks (the shuffle partitions if None); w: the rows that a value depends on.

    The order columns must be unique within a key. The partitioned rows are written once to the shared folder, since a block
    is a range partition and must not change between passes.
    """
    spark, (block, extra, place) = df.sparkSession, (temporary(df, n) for n in ("block", "extra", "place"))
    n = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(df.repartitionByRange(n, *spec.keys, *spec.order).withColumn(block, F.spark_partition_id()), "blocks")
    keys = list(spec.keys)
    sizes = rows.groupBy(*keys, block).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, 0))
    sizes = materialize(sizes.withColumn("_end", upto).withColumn("_start", F.col("_end") - F.col("_n")), "sizes")
    # a block's rows at distance r from its end are due in each later block that starts less than w - r rows after that end
    # (those are among the w blocks that follow, as no block is empty)
    ahead = Window.partitionBy(*keys).orderBy("_start").rowsBetween(1, min(w, n))
    later = sizes.withColumn("_later", F.collect_list(F.struct("_start", F.col(block).alias("_to"))).over(ahead))
    reached = later.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(block).alias("_from"), F.explode("_later").alias("_l"), "_end")
    reached = reached.where(F.col("_l._start") - F.col("_end") < w - 1)
    last = Window.partitionBy(*keys, block).orderBy(*[F.col(c).desc() for c in spec.order])
    tails = rows.withColumn(place, F.row_number().over(last)).where(F.col(place) < w)
    same = F.col(block) == F.col("_from")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    moved = tails.join(reached, same).where(F.col(place) + F.col("_l._start") - F.col("_end") < w)
    moved = moved.select(*df.columns, F.col("_l._to").alias(block), F.lit(True).alias(extra))
    whole = rows.withColumn(extra, F.lit(False)).unionByName(moved)
    return operator(whole, replace(spec, keys=(*spec.keys, block))).where(~F.col(extra)).drop(block, extra)


def _joined(kind: str, before: Column, inside: Column) -> Column:
    """Two folds of a kind taken together; NULL is the fold of nothing."""
    if kind == "first":
        return F.coalesce(before, inside)
    if kind in ("max", "min"):
        return (F.greatest if kind == "max" else F.least)(before, inside)
    both = before * inside if kind == "product" else before + inside
    return F.coalesce(both, before, inside)


def running(df: DataFrame, spec: SeriesSpec, folds: dict[str, tuple[str, Column]], blocks: int | None = None) -> DataFrame:
    """df with columns of what all rows so far fold to: folds names a kind (first, max, min, sum, product, count) and a value.

    The order columns must be unique within a key, which may be null. Rows are written once, in about so many blocks (the
    shuffle partitions if None); a series has a row a block in the table that is folded along it.
    """
    spark, block, keys = df.sparkSession, temporary(df, "block"), list(spec.keys)
    for kind, _ in folds.values():
        check_kind(kind, ("first", "max", "min", "sum", "product", "count"))
    value = {out: temporary(df, f"v{i}") for i, out in enumerate(folds)}
    rows = df.select("*", *[v.alias(value[out]) for out, (_, v) in folds.items()])
    rows = rows.repartitionByRange(blocks or int(spark.conf.get("spark.sql.shuffle.partitions")), *keys, *spec.order)
    rows = materialize(rows.withColumn(block, F.spark_partition_id()), "blocks")
    place = F.struct(*spec.order)

    def folded(kind: str, c: Column) -> Column:
        if kind == "first":
            return F.min_by(c, F.when(c.isNotNull(), place))
        return {"max": F.max, "min": F.min, "sum": F.sum, "product": F.product, "count": F.count}[kind](c)

    def over(kind: str, c: Column, w) -> Column:
        if kind == "first":
            return F.first(c, ignorenulls=True).over(w)
        return folded(kind, c).over(w)

    own = rows.groupBy(*keys, block).agg(*[folded(k, F.col(value[out])).alias(value[out]) for out, (k, _) in folds.items()])
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    before = own.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(block).alias("_at"),
        *[over("sum" if k == "count" else k, F.col(value[out]), earlier).alias(f"_b{i}") for i, (out, (k, _)) in enumerate(folds.items())],
    )
    same = F.col(block) == F.col("_at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    here = Window.partitionBy(*keys, block).orderBy(*spec.order).rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.select("*", *[over(k, F.col(value[out]), here).alias(f"{value[out]}_in") for out, (k, _) in folds.items()])
    met = inside.join(before, same)
    kept = [F.col(f"`{c}`") for c in df.columns if c not in folds]
    return met.select(*kept, *[_joined(k, F.col(f"_b{i}"), F.col(f"{value[out]}_in")).alias(out) for i, (out, (k, _)) in enumerate(folds.items())])


def drawdown(df: DataFrame, spec: SeriesSpec, raw: bool = False, value: Value = None, out: str = "drawdown", blocks: int | None = None) -> DataFrame:
    """metrics.drawdown on blocks."""
    x, top, first = spec.x(value), temporary(df, "top"), temporary(df, "first")
    rows = running(df, spec, {top: ("max", x), first: ("first", x)}, blocks)
    return rows.withColumn(out, X.fall(x, F.col(top), F.col(first), raw)).drop(top, first)


def mdd(df: DataFrame, spec: SeriesSpec, raw: bool = False, value: Value = None, out: str = "mdd", blocks: int | None = None) -> DataFrame:
    """metrics.mdd on blocks."""
    d = temporary(df, "d")
    return drawdown(df.where(spec.x(value).isNotNull()), spec, raw, value, d, blocks).groupBy(*spec.keys).agg(F.max(d).alias(out))


def perf_index(df: DataFrame, spec: SeriesSpec, base: float = 100.0, value: Value = None, out: str = "perf_index", blocks: int | None = None) -> DataFrame:
    """metrics.perf_index on blocks."""
    x, first = spec.x(value), temporary(df, "first")
    rows = running(df, spec, {first: ("first", x)}, blocks)
    return rows.withColumn(out, F.try_divide(float(base) * x, F.col(first))).drop(first)


def perf_returns(df: DataFrame, spec: SeriesSpec, kind: str = "raw", base: float = 100.0, value: Value = None, out: str = "perf_returns", blocks: int | None = None) -> DataFrame:
    """metrics.perf_returns on blocks."""
    kind = check_kind(kind, ("raw", "log", "pct"))
    r, fold, first = spec.x(value), temporary(df, "fold"), temporary(df, "first")
    rows = running(df, spec, {fold: ("product", 1 + r) if kind == "pct" else ("sum", r), first: ("first", r)}, blocks)
    level = {"raw": lambda c: float(base) + c, "log": lambda c: float(base) * F.exp(c), "pct": lambda c: float(base) * c}[kind]
    start = level(1 + F.col(first) if kind == "pct" else F.col(first))
    return rows.withColumn(out, F.try_divide(float(base) * level(F.col(fold)), start)).drop(fold, first)
