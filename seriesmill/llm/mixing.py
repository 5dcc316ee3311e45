"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions.

Targets are shares of all words by weight, stopped at a multiple of a source's size. A source's documents follow one another
in the order of a hash, again and again, until its target is met; so what a document gives follows from the words before it,
which come from sums by hash prefix and, within a prefix, from a window of bounded size. A source's weight schedule,
integrated over training time and inverted, turns its words' cumulative share into training positions.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate, pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, word_count

#: Relative weight over training time, as (time, weight) knots from time 0 to 1, for the first, second and third weight.
Knots = Sequence[tuple[float, float]]
SCHEDULES: tuple[Knots, ...] = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))


#: A table of sources is sent to all executors if it has no more rows than this, by count; else it is joined like any other.
SMALL_TABLE = 10_000


def training_time(share: Column, knots: Knots) -> Column:
    """The time by which a source has given this share of its words: the inverse of its schedule's integral.

    Within a segment of weight w and slope s, the area a is met after 2a / (w + sqrt(w^2 + 2sa)).
    """
    areas = [0.0, *accumulate((w + v) / 2 * (u - t) for (t, w), (u, v) in pairwise(knots))]
    area = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * F.lit(areas[-1])
    out = F.lit(float(knots[0][0]))
    for ((t, w), (u, v)), low in zip(pairwise(knots), areas, strict=False):
        a = area - F.lit(low)
        root = F.sqrt(F.greatest(F.lit(w * w) + F.lit(2 * (v - w) / (u - t)) * a, F.lit(0.0)))
        out = F.when(a > 0, F.lit(t) + F.coalesce(F.try_divide(F.lit(2.0) * a, F.lit(w) + root), F.lit(0.0))).otherwise(out)
    return out


def source_targets(sized: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """Of (source, size): source, sid (its place by code point, null last), weight, source_size and target, a row per source.

    Some level L has the least of cap * size and L * weight sum up to all words. Each choice of the sources that stop at
    their caps gives a line that bounds this sum from above and meets it for the right choice, so L is the greatest of the
    levels that the lines give; ordered by size per weight, the choices are the prefixes.
    """
    all_, by = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("sid", F.row_number().over(by))
    s = s.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), (F.col("sid") - 1) % len(weights)))
    ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "sid")
    before = F.coalesce(F.sum("source_size").over(ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * cap
    after = F.sum("weight").over(ratio.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (F.sum("source_size").over(all_) - before).cast("double") / after)
    top = F.max("level").over(all_)
    return s.select("source", "sid", "weight", "source_size", F.least(F.col("source_size") * float(cap), top * F.col("weight")).alias("target"))


def _order_key(id_col: str) -> Column:
    return F.coalesce(F.md5(F.col(id_col).cast("string")), F.lit(""))


def mix(rows: DataFrame, sized: DataFrame, id_col: str, source_col: str, weights: Sequence[int] = (1, 2, 3), cap: int = 3, schedules: Sequence[Knots] = SCHEDULES, rows_per_bucket: int = 5000) -> DataFrame:
    """rows (with _mix_size) with what the mix takes of each: _mix_target, _mix_source_size, _mix_taken, _mix_copies, _mix_positions.

    sized: the materialised (id, source, size) of the same rows. _mix_taken counts words, the last document of a source in
    part; _mix_copies is that in whole documents and _mix_positions the training time of each. Sources that tie, null ids,
    repeated rows and documents without words are mixed like others; an empty table stays empty.
    """
    digits, n = 0, sized.count()
    while n > rows_per_bucket * 16**digits and digits < 12:
        digits += 1
    targets = materialize(source_targets(sized, weights, cap), "targets")
    few = F.broadcast if targets.count() <= SMALL_TABLE else lambda t: t
    bucket = F.substring(_order_key("id"), 1, digits)
    keyed = sized.join(few(targets.select("sid", F.col("source").alias("s"))), sized["source"].eqNullSafe(F.col("s")))
    sums = keyed.groupBy("sid", bucket.alias("b")).agg(F.sum("size").alias("w"))
    ahead = F.coalesce(F.sum("w").over(Window.partitionBy("sid").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("sid").alias("_mix_s"), F.col("b").alias("_mix_b"), ahead.alias("_mix_ahead"))
    t = targets.select(F.col("source").alias("_mix_source"), F.col("sid").alias("_mix_sid"), F.col("source_size").alias("_mix_source_size"), F.col("target").alias("_mix_target"))
    all_rows = rows.join(few(t), rows[source_col].eqNullSafe(t["_mix_source"])).withColumn("_mix_key", _order_key(id_col)).withColumn("_mix_bucket", F.substring("_mix_key", 1, digits))
    all_rows = all_rows.join(sums, (F.col("_mix_sid") == F.col("_mix_s")) & (F.col("_mix_bucket") == F.col("_mix_b")))
    inside = Window.partitionBy("_mix_sid", "_mix_bucket").orderBy("_mix_key", id_col, "_mix_size").rowsBetween(Window.unboundedPreceding, -1)
    need = F.floor(F.col("_mix_target") + 0.5)
    size, total, at = F.col("_mix_size"), F.col("_mix_source_size"), F.col("_mix_at")
    out = all_rows.withColumn("_mix_at", F.col("_mix_ahead") + F.coalesce(F.sum("_mix_size").over(inside), F.lit(0))).withColumn("_mix_need", need)
    out = out.withColumn("_mix_rounds", F.when(total > 0, F.floor(F.try_divide(F.col("_mix_need"), total))).otherwise(F.lit(0)))
    rest = F.col("_mix_need") - F.col("_mix_rounds") * total
    out = out.withColumn("_mix_taken", (F.col("_mix_rounds") * size + F.greatest(F.lit(0), F.least(size, rest - at))).cast("long"))
    out = out.withColumn("_mix_copies", (F.col("_mix_rounds") + F.when(2 * (rest - at) > size, 1).otherwise(0)).cast("int"))
    share = lambda e: F.try_divide(e * total + at + size / F.lit(2.0), F.col("_mix_need"))
    place = F.element_at(F.array(*[F.lit(i) for i in range(len(schedules))]), (F.col("_mix_sid") - 1) % len(schedules) + 1)

    def position(e: Column) -> Column:
        chosen = training_time(share(e), schedules[0])
        for i, knots in enumerate(schedules[1:], 1):
            chosen = F.when(place == i, training_time(share(e), knots)).otherwise(chosen)
        return F.coalesce(chosen, F.lit(0.0))

    none = F.array().cast("array<double>")
    count = F.greatest(F.col("_mix_copies"), F.when(F.col("_mix_taken") > 0, 1).otherwise(0))
    positions = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda e: position(e.cast("long")))).otherwise(none)
    return out.withColumn("_mix_positions", positions).drop("_mix_source", "_mix_sid", "_mix_s", "_mix_b", "_mix_key", "_mix_bucket", "_mix_ahead", "_mix_at", "_mix_need", "_mix_rounds")


def decisions(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """A row per row of docs: id_col, size, source_size, target, taken and position (of the first copy; null if none is taken),
    range-sorted by position. Other columns are ignored, whatever their names."""
    sized = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "sized")
    found = mix(sized.withColumn("_mix_size", F.col("size")), sized, "id", "source", **options)
    out = found.select(F.col("id").alias(id_col), "size", F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), F.col("_mix_taken").alias("taken"), F.round(F.get("_mix_positions", F.lit(0)), 9).alias("position"))
    return out.repartitionByRange(shuffle_partitions(docs.sparkSession), "position", id_col).sortWithinPartitions("position", id_col)


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it takes them, range-sorted by training position.

    A document of which only a part is due is taken whole if that part is more than half of it. Columns stay as they are,
    whatever their names.
    """
    columns, own = docs.columns, {c: f"_own{i}" for i, c in enumerate(docs.columns) if c.startswith(("_mix_", "_own"))}
    docs = docs.select(*[F.col(f"`{c}`").alias(own.get(c, c)) for c in columns])
    id_col, source_col, text_col = (own.get(c, c) for c in (id_col, source_col, text_col))
    sized = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "sized")
    found = mix(docs.withColumn("_mix_size", word_count(F.col(text_col))), sized, id_col, source_col, **options)
    copies = found.withColumn("_mix_position", F.explode(F.slice("_mix_positions", F.lit(1), F.col("_mix_copies"))))
    parts = shuffle_partitions(docs.sparkSession)
    return copies.repartitionByRange(parts, "_mix_position", id_col).sortWithinPartitions("_mix_position", id_col).select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in columns])
