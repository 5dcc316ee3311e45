"""Toxicity: automata against edit distance, context, held-out accuracy."""

import random
import string

import pytest
from pyspark.sql import functions as F

from seriesmill.llm import toxicity as T


def distance(a, b):
    """Edit distance with adjacent swaps as one error."""
    d = [[max(i, j) if not min(i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_matcher_equals_edit_distance():
    rng = random.Random(0)
    terms = [T.Term(w) for w in ("idiot", "stupid", "scum", "worthless", "disgusting", "abcab", "abcba")] + [T.Term("grumb", True)]
    m = T.Matcher(terms, known=50)
    pool = [t.text for t in terms]
    for _ in range(6000):
        w = list(rng.choice(pool))
        for _ in range(rng.randint(0, 3)):
            p = rng.randrange(len(w) + 1)
            kind = rng.randrange(4)
            if kind == 0:
                w.insert(p, rng.choice("abcdioust1!"))
            elif kind == 1 and p < len(w):
                w.pop(p)
            elif kind == 2 and p < len(w):
                w[p] = rng.choice("abcdioust1!")
            elif p + 1 < len(w):
                w[p], w[p + 1] = w[p + 1], w[p]
        word = "".join(w)
        words = [t for t in terms if not t.rest]
        want = 1 if any(t.text == word for t in words) else 2 if any(distance(t.text, word) <= t.errors for t in words) else 3 if word.startswith("grumb") else 0
        assert m.match(word) == want, word
        assert m.match(word) == want


def test_quotation_is_not_abuse():
    m = T.Matcher([T.Term("idiot")])
    at = dict(zip(T.FEATURES, range(len(T.FEATURES)), strict=True))
    abuse = T.features("you are an idiot and an idiiot", m)
    quoted = T.features('she said the word "idiot" is rude', m)
    assert abuse[at["exact"]] > 0 and abuse[at["fuzzy"]] > 0 and abuse[at["addressed"]] > 0 and abuse[at["quoted"]] == 0
    assert quoted[at["exact"]] == 0 and quoted[at["quoted"]] > 0
    assert T.features("", m) == [0.0] * 6


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(1)
    vocab = ["".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    insults = ["vroknar", "slimbo", "gratfool"]
    rows, labels = [], []
    for d in range(1500):
        words = [rng.choice(vocab) for _ in range(60)]
        toxic = d % 8 == 0
        if toxic:
            for _ in range(2):
                words[rng.randrange(60)] = rng.choice(insults)
        rows.append((d, " ".join(words)))
        labels.append((d, int(toxic)))
    misspelt, quoted, abused = [], [], []
    for d in range(2000, 2060):
        words = [rng.choice(vocab) for _ in range(60)]
        term = rng.choice(insults)
        w = list(term)
        w[rng.randrange(1, len(w))] = "*"
        misspelt.append((d, " ".join([*words[:30], "".join(w), *words[30:]])))  # its only sign
        quoted.append((d, " ".join([*words[:30], "they", "wrote", f'"{term}"', *words[30:]])))
        abused.append((d, " ".join([*words[:30], "you", "are", term, *words[30:]])))
    make = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    return make(rows), spark.createDataFrame(labels, "doc_id long, toxic int"), make(misspelt), make(quoted), make(abused), insults


def test_held_out_accuracy(planted):
    docs, labels, misspelt, quoted, abused, insults = planted
    model = T.train(docs, labels)
    assert {t.text for t in model.terms} == set(insults)
    got = T.score(docs, model).join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 4 = 2")
    wrong = got.where((F.col("toxicity") >= 0.3).cast("int") != F.col("toxic")).count()
    assert got.count() > 200 and wrong <= 2
    weight = dict(zip(T.FEATURES, model.weights[1:], strict=True))
    assert weight["exact"] > 0 and weight["fuzzy"] > 0 and weight["quoted"] <= 0
    toxic = lambda d: T.score(d, model).where("toxicity >= 0.3").count()
    assert toxic(misspelt) == 60 and T.without_toxic(misspelt, model).count() == 0
    assert toxic(abused) == 60 and toxic(quoted) == 0


def test_misspellings_and_quotations_made_for_training():
    m = T.Matcher([T.Term(w) for w in ("idiot", "worthless", "disgusting", "vroknar", "slimbo")])
    for t in ("idiot", "worthless", "disgusting", "vroknar", "slimbo"):
        assert T.misspelt(t) != t and m.match(T.misspelt(t)) == 2
    (one, bad), (zero, quoting) = T.contrasts("You are an idiot, so worthless.", m)
    at = dict(zip(T.FEATURES, range(len(T.FEATURES)), strict=True))
    assert (one, zero) == (1, 0) and T.features(bad, m)[at["fuzzy"]] > 0 == T.features(bad, m)[at["exact"]]
    assert T.features(quoting, m)[at["quoted"]] > 0 == T.features(quoting, m)[at["exact"]]
    assert T.contrasts("nothing here", m) == []


def test_ordinary_words_are_no_misspellings(spark):
    rng = random.Random(2)
    filler = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(12))
    rows = [(d, f"{filler()} {'idiom' if d % 3 else 'idiot'} {filler()}") for d in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = T.train(docs, spark.createDataFrame([(d, int(d % 3 == 0)) for d, _ in rows], "doc_id long, toxic int"))
    assert "idiom" in model.ordinary and model.matcher().match("idiom") == 0 and model.matcher().match("idi0t") == 2


def test_copies_count_once():
    assert T.first_copies([(5, [1, 2]), (3, [9, 2]), (4, [7, 8]), (9, [9, 1])]) == [3, 4]


def test_very_long_text(planted, spark):
    docs, labels, *_, insults = planted
    model = T.train(docs, labels)
    long = [(1, ("thing " * 20 + insults[0] + " ") * 20_000), (2, "x" * 10**6), (3, f'"{insults[1]}" ' * 10_000)]
    got = {r["doc_id"]: r["toxicity"] for r in T.score(spark.createDataFrame(long, "doc_id long, text string"), model).collect()}
    assert got[1] >= 0.3 and got[2] < 0.3 and got[3] < 0.3


def test_labels_of_held_out_rows_do_not_matter(planted):
    docs, labels, *_ = planted
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert T.train(docs, labels) == T.train(docs, flipped)


def test_awkward_rows(spark, awkward, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = T.train(awkward, none)
    assert T.score(awkward, model).where("toxicity between 0 and 1").count() == awkward.count()
    assert T.without_toxic(awkward, model).count() == awkward.count()
    odd = spark.createDataFrame([(5, 1), (None, 1), (4, None), (7, 0)], "doc_id long, toxic int")
    assert T.score(awkward, T.train(awkward, odd)).count() == awkward.count()
    assert T.score(empty, model).count() == 0 and T.without_toxic(empty, model).count() == 0
