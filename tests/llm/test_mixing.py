"""Mixing: targets by repeated resharing, taken words by walking the stream, positions by integration."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from seriesmill.llm import mixing


def brute(rows, cap=3):
    size = defaultdict(int)
    for _, s, n in rows:
        size[s] += n
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, left, free = dict.fromkeys(order, 0.0), float(sum(size.values())), set(order)
    while left > 1e-9 and free:
        share = left / sum(weight[s] for s in free)
        left = 0.0
        for s in list(free):
            target[s] += share * weight[s]
            if target[s] >= cap * size[s]:
                left += target[s] - cap * size[s]
                target[s] = cap * size[s]
                free.discard(s)
    out = []
    for s in order:
        docs = sorted((r for r in rows if r[1] == s), key=lambda r: ("" if r[0] is None else hashlib.md5(str(r[0]).encode()).hexdigest(), r[0] is not None, r[0] or 0, r[2]))
        need, taken, at = int(target[s] + 0.5), defaultdict(int), 0
        while at < need and size[s]:
            for k, (_, _, n) in enumerate(docs):
                taken[k] += max(0, min(n, need - at))
                at += n
        out += [(d, n, size[s], target[s], taken[k]) for k, (d, _, n) in enumerate(docs)]
    return sorted(out, key=str)


def rows_of(docs):
    import re

    return [(r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in docs.collect()]


def compare(docs, **options):
    got = sorted((tuple(r)[:5] for r in mixing.decisions(docs, **options).collect()), key=str)
    want = brute(rows_of(docs))
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: (str(r[0]), r[1], r[2], r[4])), sorted(want, key=lambda r: (str(r[0]), r[1], r[2], r[4])), strict=True):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3]) and abs(g[4] - w[4]) <= 1 and g[4] <= 3 * g[1]


@pytest.mark.parametrize("rows_per_bucket", [5000, 3])
def test_against_brute_force(sample, rows_per_bucket):
    compare(sample, rows_per_bucket=rows_per_bucket)


def test_taken_words_meet_targets_and_reruns_agree(sample):
    d = mixing.decisions(sample)
    by = d.groupBy("source_size", "target").agg(F.sum("taken").alias("t"))
    assert by.where("abs(t - target) > 1").count() == 0
    assert sorted(d.collect()) == sorted(mixing.decisions(sample.repartition(7)).collect())


def test_caps_and_awkward_rows(documents, awkward, empty):
    rows = [(i, "w " * 10, None, "small" if i < 2 else "zz" if i < 4 else "a", 0) for i in range(40)]
    compare(documents(rows))
    compare(awkward)
    assert mixing.decisions(empty).count() == 0 and mixing.mixed(empty).count() == 0
    blank = documents([(1, " ", None, "a", 1), (2, None, None, "b", None)])
    assert [r["taken"] for r in mixing.decisions(blank).collect()] == [0, 0]


def test_training_time_inverts_the_integral(spark):
    knots = ((0.0, 0.0), (0.25, 2.0), (0.5, 0.5), (1.0, 1.0))

    def area(t):
        total = 0.0
        for (a, w), (b, v) in zip(knots, knots[1:], strict=False):
            if t > a:
                x = min(t, b) - a
                total += w * x + (v - w) / (b - a) * x * x / 2
        return total

    shares = [i / 50 for i in range(51)]
    rows = spark.createDataFrame([(s,) for s in shares], "s double").select("s", mixing.training_time(F.col("s"), knots).alias("t")).collect()
    for r in rows:
        assert area(r["t"]) / area(1.0) == pytest.approx(r["s"], abs=1e-9)


def test_mixed_rows(sample):
    out = mixing.mixed(sample.withColumn("size", F.lit("x")).withColumn("_sid", F.lit(1)))
    assert out.columns == [*sample.columns, "size", "_sid"]
    words = lambda d: sum(n for _, _, n in rows_of(d))
    assert abs(words(out) - words(sample)) < 0.15 * words(sample)
    assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    plan = mixing.decisions(sample)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
