"""Connected components by alternating large and small stars, entirely in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the least node around it."""
    both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).union(edges.select("v", "u"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("m").alias("u"), F.col("b").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the least of them; u < v in edges and in the result."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    moved = edges.join(least, "v").where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))
    return moved.union(least.select(F.col("m").alias("u"), "v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v: long), root being the least node that it reaches; isolated nodes are absent.

    Nulls and loops are no edges. Each round is two joins and two partial minima, so a hub's edges meet in no single
    task; a round's table is written to the shared folder and replaces the one before.
    """
    now = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    now = materialize(now, "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root")).union(now.select("u", "u").distinct())
        after = materialize(_small(_large(now)), "edges")
        discard(now)
        now, seen = after, mark
