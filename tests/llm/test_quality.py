"""Quality measures against a plain computation; the cascade's order and verdict."""

import re
from collections import Counter

import pytest

from seriesmill.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    words = WORD.findall(t)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in Q.SYMBOLS for c in t), len(lines) - len(set(lines)), len(inside)


def check(docs):
    text = {}
    for r in docs.collect():
        text.setdefault(r["doc_id"], []).append(r["text"])
    for r in Q.cascade(docs).collect():
        want = brute(text[r["doc_id"]][0])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_against_brute_force(sample):
    check(sample)


def test_awkward_rows(documents, awkward, empty):
    check(awkward)
    assert Q.cascade(empty).count() == 0
    texts = ["a b c d e", "a b c d e a b c d e", "a a a a a a a a", "x y z\n\nx y z\n x y z\nx y z\n \n", "a b c d e f " * 400, "\x0b\x0c", "1 2 3 4 5 1 2 3 4 5 6 7 8 9 0 1 2 3 4 5"]
    check(documents([(i, t, None, None, 0) for i, t in enumerate(texts)]))


def test_clean_documents_are_kept(spark, sample):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    good = Q.cascade(sample).join(labels.where("quality = 1"), "doc_id")
    assert good.where("not kept and not base_failed").count() == 0


def test_order_is_rejection_per_cost(sample):
    m = Q.measured(sample).persist()
    rules = [Q.Rule("never", "n_words < 0"), Q.Rule("always", "n_words >= 0"), Q.Rule("unknown", "cast(null as boolean)")]
    order = Q.cascade_order(m, rules)
    assert order[0][0].name == "always" and order[0][2] == 1 and {o[2] for o in order[1:]} == {0}
    got = m.select(Q.verdict(rules).alias("v")).distinct().collect()
    assert [r["v"] for r in got] == ["always"]


@pytest.mark.parametrize("n", [3, 4])
def test_other_windows(spark, n):
    df = spark.createDataFrame([("a b c x a b c",)], "text string")
    assert df.select(Q.repeated_words(df["text"], n)).first()[0] == (6 if n == 3 else 0)


def test_no_python_in_the_plan(sample):
    plan = Q.cascade(sample)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
