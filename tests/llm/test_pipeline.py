"""The pipeline's stages and the registered queries of this subpackage."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seriesmill.llm import queries as Q

SMALL = "/root/testdata/sf0.001"


def test_stages(spark, sample):
    docs, kept = sample, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == sample.columns and out.dtypes == sample.dtypes, name
        docs = out.persist()
        kept.append(docs.count())
    assert sample.count() >= kept[0] >= kept[1] == kept[2] > 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert out.where("piece = 0").count() == kept[-1]


def test_stages_on_awkward_rows(spark, awkward, empty):
    for docs in (awkward, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            out.write.format("noop").mode("overwrite").save()
            if name != "packing":
                assert out.columns == docs.columns


def test_run(spark):
    first, again = (sorted(map(tuple, corpus_pipeline.run(spark, SMALL).select("doc_id", "piece", "start", "length", "ids_crc32").collect())) for _ in range(2))
    assert first == again and first


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_queries_run(spark, name):
    df = Q.QUERIES[name](spark, SMALL)
    assert "doc_id" in df.columns or name in ("op6_url_filter", "op10_chat_formatting")
    assert df.count() >= 0


@pytest.mark.parametrize("name", list(Q.SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    want = con.execute(Q.SQL[name])
    columns = [c[0] for c in want.description]
    got = Q.QUERIES[name](spark, SMALL)
    assert set(got.columns) == set(columns)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))


def test_pii_counts_are_of_base_spans(spark):
    r = Q.op4_pii(spark, SMALL)
    total = F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone")
    listed = F.when(F.col("spans") == "", 0).otherwise(F.size(F.split("spans", ",")))
    assert r.where(total > listed).count() == 0 and r.agg(F.sum(total)).first()[0] > 0
