"""Helpers that the text operators share: materialised tables, native word counts and word iteration."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..cluster import discard, mark, materialize, shared_dir, ship, sweep

#: The characters that separate words: space and the ASCII controls 9 to 13.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\x0c\r"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def python_workers(spark: SparkSession, rows: int = 1000) -> None:
    """Sends the package to the Python workers and bounds Arrow batches, which hold whole texts, so that memory stays small."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def word_count(text: Column) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+` in text, without building an array of them; 0 for null."""
    tight = F.regexp_replace(F.ltrim(text, F.lit(SPACES)), f"[^{SPACE_CLASS}]++[{SPACE_CLASS}]*+", "w")
    return F.coalesce(F.length(tight), F.lit(0)).cast("long")


def word_blocks(data: bytes, size: int = 1 << 22):
    """The words of data in lists, each of about size bytes of text: long texts never become one list."""
    at = 0
    while len(data) - at > size:
        found = _SPACE.search(data, at + size)
        if not found:
            break
        yield data[at : found.start()].split()
        at = found.start()
    yield (data[at:] if at else data).split()
