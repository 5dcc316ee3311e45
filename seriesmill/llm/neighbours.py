"""Fingerprints of documents and of their edited texts, in descending order of their ids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import parsing as P
from .common import shuffle_partitions, python_workers

SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint) for every row of docs; null texts count as empty, other columns are ignored."""
    python_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = P.fingerprints([P.code_points(t.as_py() or "") for t in b.column(1)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([P.text_of(f) for f in fps], pa.string())], ["id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


def _bounds(heads: list[int]) -> Column:
    """heads as one constant, whatever their number."""
    return F.split(F.lit(",".join(map(str, heads))), ",").cast("array<bigint>")


def _slot(value: Column, heads: list[int]) -> Column:
    """How many of heads (falling) are greater than or equal to value, less one: a binary search as one expression."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(heads).bit_length()))])
    jump = lambda at, s: F.when((at + s < len(heads)) & (F.get(_bounds(heads), at + s) >= value), at + s).otherwise(at)
    return F.aggregate(steps, F.lit(0), jump)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by slot and place; each row's next is the row after it in its slot, the last being only that."""
    held: P._Doc | None = None
    slot_of_held = None

    def out(pairs: list[tuple[P._Doc, P._Doc]]) -> pa.RecordBatch:
        edits = [P.edited(a.points, b.points) for a, b in pairs]
        fps = P.fingerprints(edits)
        rows = [(a, b, e, f) for (a, b), e, f in zip(pairs, edits, fps, strict=True)]
        return P.to_arrow({
            "doc_id": ([a.id for a, *_ in rows], pa.int64()),
            "n_chars": ([len(a.points) for a, *_ in rows], pa.int64()),
            "edited_sha256": ([hashlib.sha256(e.tobytes().decode("utf-32-le", "surrogatepass").encode()).hexdigest() for _, _, e, _ in rows], pa.string()),
            "fingerprint": ([P.text_of(a.fp) for a, *_ in rows], pa.string()),
            "edited_fingerprint": ([P.text_of(f) for *_, f in rows], pa.string()),
            "near_edited": ([P.likeness(a.fp, f) for a, _, _, f in rows], pa.float64()),
            "near_next": ([P.likeness(a.fp, b.fp) for a, b, *_ in rows], pa.float64()),
        })

    for b in batches:
        if not b.num_rows:
            continue
        slots = b.column(0).to_pylist()
        docs = P.document_batch([(i, t or "") for i, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)])
        pairs = []
        for slot, doc in zip(slots, docs, strict=True):
            if held is not None and slot == slot_of_held:
                pairs.append((held, doc))
            held, slot_of_held = doc, slot
        if pairs:
            yield out(pairs)


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA for every row: fingerprints of the text and of the text whose last third the next document's start replaces.

    The next document has the greatest id below (after the least comes the greatest again). Null ids come last and rows
    with one id are ordered by text; a single row is its own next. Null texts count as empty. An empty table gives an
    empty result. Texts cross the network once: a pass over the ids alone cuts their order into slots of like size, and
    each slot also gets the first row of the slot that follows.
    """
    spark = docs.sparkSession
    python_workers(spark, 500)
    parts = shuffle_partitions(spark)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    cut = min(4 * parts, 20_000)
    at = [i / cut for i in range(1, cut)]
    stats = own.agg(F.percentile_approx("id", F.array(*[F.lit(x) for x in at]), 10 * cut).alias("q"), F.max("id").alias("top"), F.count("*").alias("n"), F.count("id").alias("ids")).first()
    if not stats["n"]:
        return spark.createDataFrame([], SCHEMA)
    heads = sorted({*(stats["q"] or []), *([stats["top"]] if stats["top"] is not None else [])}, reverse=True)
    slots = len(heads) + (stats["ids"] < stats["n"])  # null ids have the last slot
    value = F.col("id")
    slot = F.when(value.isNull(), slots - 1).otherwise(_slot(value, heads)) if heads else F.lit(0)
    placed = own.select(slot.cast("int").alias("slot"), "id", "text")
    # the first row of a slot: the least text of its greatest id
    at_head = value.isNull() | (value == F.get(_bounds(heads), F.col("slot"))) if heads else F.lit(True)
    first = placed.where(at_head).groupBy("slot").agg(F.min_by(F.struct("id", "text"), F.coalesce("text", F.lit(""))).alias("r"))
    tails = first.select(F.pmod(F.col("slot") - 1, F.lit(slots)).cast("int").alias("slot"), F.col("r.id").alias("id"), F.col("r.text").alias("text"), F.lit(True).alias("tail"))
    rows = placed.withColumn("tail", F.lit(False)).union(tails)
    dealt = rows.repartition(parts, "slot").sortWithinPartitions("slot", "tail", F.col("id").desc_nulls_last(), F.coalesce("text", F.lit("")))
    return dealt.select("slot", "id", "text").mapInArrow(_chained, SCHEMA)
