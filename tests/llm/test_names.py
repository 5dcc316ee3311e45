"""Tables with extra columns that bear the names operators use within."""

from pyspark.sql import functions as F

from seriesmill.llm import chaining, mixing, neighbours, pii, quality, simhash, toxicity

NAMES = (
    "_mix_size", "_mix_key", "_mix_target", "_own1", "id", "doc", "seed", "chain", "asked", "found", "_found", "spans", "slot", "fp", "rep", "root", "node",
    "position", "size", "target", "taken", "rejected_by", "n_words", "kept", "term", "toxic", "mark", "marks", "toxicity", "row", "_copy", "a b", "u", "v",
)


def test_clashing_names(spark, sample):
    plain = spark.createDataFrame(sample.orderBy("doc_id").limit(150).collect(), sample.schema)
    docs = plain.select("*", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in NAMES])
    labels = plain.select("doc_id", F.col("text").contains("the").cast("int").alias("toxic"))
    for run in (chaining.repeated_passages, mixing.decisions, neighbours.edited_likeness, pii.find_personal_data, quality.cascade, simhash.near_duplicates):
        got, want = (sorted(map(str, run(d).drop("rejected_by").collect())) for d in (docs, plain))
        assert got == want, run.__name__
    model = toxicity.train(docs, labels)
    assert model == toxicity.train(plain, labels)
    assert toxicity.score(docs, model).count() == 150
    for run in (mixing.mixed, pii.redact, simhash.keep_one, lambda d: toxicity.without_toxic(d, model)):
        out = run(docs)
        assert out.columns == docs.columns
        for r in out.limit(20).collect():
            assert all(r[n] == f"{n}{r['doc_id']}" for n in NAMES)
