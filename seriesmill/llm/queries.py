"""The registered queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tokenizer file of the installed vocabulary package; the operators take any other as a parameter.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(_documents(spark, sf_dir))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_documents(spark, sf_dir), tokenizer_path())


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import edited_likeness

    return edited_likeness(_documents(spark, sf_dir))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, find_personal_data, written

    spans = find_personal_data(_documents(spark, sf_dir))
    base = F.filter("spans", lambda x: x["base"])
    of_kind = lambda k: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == k))).cast("long")
    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return spans.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chaining import repeated_passages

    return repeated_passages(_documents(spark, sf_dir))


def _entries(pages: DataFrame) -> DataFrame:
    """(key, action, at) of a dated list for pages, and so a stand-in for the list that the tables don't have.

    Of the hosts, the domains of three labels and the hosts' first path segments, those are listed whose MD5 begins with
    certain digits: on a day that it gives, and some of them until 60 days later, of which some again after 60 more.
    """
    from .urls import PATH, host

    path = F.regexp_extract("url", PATH, 1)
    cut = pages.select(host(F.col("url")).alias("host"), F.regexp_extract(path, "^/+([^/]+)", 1).alias("segment")).where("host <> ''").distinct()
    keys = cut.select(F.explode(F.array("host", F.when(F.col("segment") != "", F.concat_ws("/", "host", "segment")), F.regexp_extract("host", "([^.]+[.][^.]+[.][^.]+)$", 1))).alias("key"))
    hashed = keys.where("key is not null and key <> ''").distinct().withColumn("h", F.md5("key"))
    day = F.expr("date_add(date'2024-01-01', (ascii(substring(h, 2, 1)) * 31 + ascii(substring(h, 3, 1))) % 200)")
    added = hashed.where("substring(h, 1, 1) < '5'").select("key", F.lit("add").alias("action"), day.alias("at"))
    removed = hashed.where("substring(h, 1, 1) < '3'").select("key", F.lit("remove").alias("action"), F.date_add(day, F.lit(60)).alias("at"))
    again = hashed.where("substring(h, 1, 1) < '1'").select("key", F.lit("add").alias("action"), F.date_add(day, F.lit(120)).alias("at"))
    return added.union(removed).union(again)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a capture; the tables hold no fetch times, so page_id gives a day of 2024."""
    from .urls import filter_urls

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    fetched = pages.withColumn("fetched", F.expr("date_add(date'2024-01-01', cast(page_id % 366 as int))"))
    return filter_urls(fetched, _entries(pages)).withColumn("fetched", F.col("fetched").cast("string"))


_OP6_SQL = r"""
WITH p AS (
  SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS DATE) AS fetched,
    regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^/?#\]]*\]|[^/?#:]*)', 1)), '[.]\z', '') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), q AS (SELECT *, regexp_extract(path, '^/+([^/]+)', 1) AS segment, regexp_extract(host, '([^.]+[.][^.]+[.][^.]+)$', 1) AS tail FROM p),
keys AS (
  SELECT host AS key FROM q UNION SELECT host || '/' || segment FROM q WHERE segment <> '' AND host <> '' UNION SELECT tail FROM q
), hashed AS (SELECT key, md5(key) AS h FROM keys WHERE key <> ''),
dated AS (SELECT key, h, DATE '2024-01-01' + CAST((ascii(substr(h, 2, 1)) * 31 + ascii(substr(h, 3, 1))) % 200 AS INTEGER) AS a FROM hashed WHERE substr(h, 1, 1) < '5'),
spans AS (
  SELECT key, a AS start, CASE WHEN substr(h, 1, 1) < '3' THEN a + 60 END AS stop FROM dated
  UNION ALL SELECT key, a + 120, NULL FROM dated WHERE substr(h, 1, 1) < '1'
), hits AS (
  SELECT q.page_id, q.url, q.fetched, s.key FROM q JOIN spans s
  ON (q.host = s.key OR ends_with(q.host, '.' || s.key) OR q.host || '/' || q.segment = s.key)
  AND q.fetched >= s.start AND (s.stop IS NULL OR q.fetched < s.stop)
), best AS (
  SELECT page_id, url, fetched, count(*) AS n, min(struct_pack(n := -length(key), k := key)).k AS matched FROM hits GROUP BY ALL
)
SELECT p.page_id, p.url, CAST(p.fetched AS VARCHAR) AS fetched, coalesce(b.n, 0) > 0 AS blocked, coalesce(b.n, 0) AS n_matches, b.matched
FROM p LEFT JOIN best b ON p.page_id = b.page_id AND p.url = b.url AND p.fetched = b.fetched
"""


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import decisions

    return decisions(_documents(spark, sf_dir))


_OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM d GROUP BY source),
w AS (SELECT *, (sid - 1) % 3 + 1 AS weight FROM s),
l AS (
  SELECT *, CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / CAST(weight AS DOUBLE), sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER (ORDER BY source_size / CAST(weight AS DOUBLE), sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM w
), t AS (SELECT *, least(CAST(source_size AS DOUBLE) * CAST(3 AS DOUBLE), max(level) OVER () * CAST(weight AS DOUBLE)) AS target FROM l),
c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.sid, CAST(floor(t.target + CAST(0.5 AS DOUBLE)) AS BIGINT) AS need,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY t.sid ORDER BY md5(CAST(d.doc_id AS VARCHAR)), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), r AS (SELECT *, CASE WHEN source_size > 0 THEN need // source_size ELSE 0 END AS rounds FROM c),
k AS (
  SELECT *, CAST(rounds * size + greatest(0, least(size, need - rounds * source_size - pos)) AS BIGINT) AS taken,
    (CAST(pos AS DOUBLE) + CAST(size AS DOUBLE) / CAST(2 AS DOUBLE)) / CAST(nullif(need, 0) AS DOUBLE) AS share FROM r
), z AS (SELECT *, (sid - 1) % 3 AS place, least(greatest(share, CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE)) AS u FROM k)
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN taken > 0 THEN round(coalesce(CASE place
    WHEN 0 THEN 2 * u / (1.5 + sqrt(greatest(2.25 - 2 * u, CAST(0 AS DOUBLE))))
    WHEN 1 THEN u
    ELSE CASE WHEN u > 0.375 THEN 0.5 + 2 * (u - 0.375) / (1 + sqrt(1 + 2 * (u - 0.375))) ELSE 2 * u / (0.5 + sqrt(0.25 + 2 * u)) END END, 0), 9) END AS position
FROM z
"""


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score, train

    docs = _documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = score(docs, model)
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import cascade

    return cascade(_documents(spark, sf_dir)).drop("rejected_by")


_OP9_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) > 4),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, list_slice(ws, i, i + 4)) AS n FROM g),
c AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS j FROM h WHERE n > 1),
k AS (SELECT r, CAST(sum(least(5, coalesce(j - i, 5))) AS BIGINT) AS n_repeat_words FROM c GROUP BY r),
m AS (
  SELECT w.doc_id, t, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN k USING (r)
), b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR 5 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
    OR 2 * length(regexp_replace(t, '[^\p{L}]+', '', 'g')) < word_chars OR 2 * length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) > word_chars
    OR 20 * len(regexp_extract_all(t, '[{}\;=~^]')) > word_chars
    OR 10 * len(regexp_extract_all(t || chr(10), '(?:[.]{3}|…)[\x20\x09\x0D]*\n')) > 3 * n_lines
    OR 10 * len(regexp_extract_all(chr(10) || t, '\n[\x20\x09]*[-*•]\x20')) > 9 * n_lines) AS kept
FROM b
"""


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import digests, format_conversations

    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digests(format_conversations(rows.unionByName(own), tokenizer_path()), tokenizer_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_best_fit_packing,
        op3_document_fingerprints,
        op4_pii,
        op5_substring_dedup,
        op6_url_filter,
        op7_source_mixing,
        op8_toxicity,
        op9_quality_rules,
        op10_chat_formatting,
    )
}

#: For the others SQL can't express the result (hash functions, tokenizers, trained models); tests hold them against brute force.
SQL: dict[str, str] = {"op6_url_filter": _OP6_SQL, "op7_source_mixing": _OP7_SQL, "op9_quality_rules": _OP9_SQL}
