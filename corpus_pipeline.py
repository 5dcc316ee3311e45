"""A corpus pipeline in five stages, each of which calls one operator of seriesmill.llm on all that the stage before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seriesmill.llm.common import discard, mark, materialize, sweep
from seriesmill.llm.mixing import mixed
from seriesmill.llm.packing import pack_documents
from seriesmill.llm.pii import redact
from seriesmill.llm.queries import tokenizer_path
from seriesmill.llm.simhash import keep_one
from seriesmill.llm.toxicity import train, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity model, trained on the labels, doesn't reject; see toxicity.without_toxic."""
    return without_toxic(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles connect at a similarity of 0.8 or more; see simhash.keep_one."""
    return keep_one(docs, words=5, similarity=0.8)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; see pii.redact."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order; see mixing.mixed."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in sequences of 2048 tokens; see packing.pack_documents."""
    return pack_documents(docs, tokenizer_path(), 2048)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("packing", packing),
]

#: The stages train models, hash with XXH64 and tokenize, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over documents. What a stage wrote on its way goes when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        begun, before = mark(), docs
        docs = materialize(stage(spark, before, sf_dir), f"stage-{name}")
        sweep(spark, begun, keep=[docs])
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
