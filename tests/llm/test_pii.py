"""Personal data: base spans against Python's patterns, the added ones, redaction."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seriesmill.llm import pii

# The patterns as they are stated, without the guards that keep them linear.
STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def valid(kind, span):
    digits = re.sub("[^0-9]", "", span)
    if kind == "ip":
        return all(int(p) <= 255 for p in span.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), k, m.end()) for k, kind in enumerate(pii.KINDS) for m in re.finditer(STATED[kind], text or "", re.A) if valid(kind, m[0])]
    return [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found)]


def base_spans(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.find_personal_data(docs).collect()
    return {r["doc_id"]: [f"{pii.KINDS[s['kind']]}:{s['start']}:{s['stop']}" for s in r["spans"] if s["base"]] for r in rows}


TEXTS = [
    None,
    "",
    "mail a.b@c.example.com, x@y and a@b.c_d@e.f.g, @@a@b.cc..dd",
    "𝒳é a%b+c@d-e.f 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.004 1.2.3 0255.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111x 12 3",
    "+1 (578) 555-6437 491 +12 3, +33.1.23.45.67.89) ++49 30 123456 +1 2345678901234567",
    "call (212) 555-1234 or 212-555-9876, mail joe (at) site (dot) com, 2001:0db8:0000:0000:0000:ff00:0042:8329 card 4111.1111.1111.1111",
    "9" * 400 + "." + "8" * 30,
    "a" * 3000 + "@" + "b" * 30 + ".c",
]


def test_base_spans(spark, sample):
    texts = TEXTS + [r["text"] for r in sample.collect()]
    got = base_spans(spark, texts)
    for i, t in enumerate(texts):
        assert got[i] == brute(t), t


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text("019+ ().-@ab%_é\n", max_size=60), min_size=150, max_size=150))
def test_base_spans_of_any_text(spark, texts):
    got = base_spans(spark, texts)
    for i, t in enumerate(texts):
        assert got[i] == brute(t), t


def test_loose_spans_are_added_and_base_ones_stay(spark):
    rows = [(i, f"please call phone (212) 555-{1000 + i} now, or mail us at joe{i}@example.com or joe{i} (at) site (dot) com") for i in range(60)]
    found = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in found:
        kinds = [(s["kind"], s["base"]) for s in r["spans"]]
        assert (0, True) in kinds and (3, False) in kinds and (0, False) in kinds
        assert [s["start"] for s in r["spans"]] == sorted(s["start"] for s in r["spans"])


def test_a_few_good_labelers_outweigh_a_majority_of_weak_ones():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.5
    right = rng.random((4000, 5)) < [0.55, 0.55, 0.55, 0.93, 0.93]
    votes = np.where(right == truth[:, None], 1, -1)
    patterns = sorted(Counter(map(tuple, votes.tolist())).items())
    _, shares, post = pii.reliabilities(patterns)
    found = dict(zip((v for v, _ in patterns), post, strict=True))
    assert found[1, 1, 1, -1, -1] < 0.2 and found[-1, -1, -1, 1, 1] > 0.8
    assert shares[3, 1, 2] > 0.88 and shares[0, 1, 2] < 0.65


LOOSE_TRUE = [
    ("email", "write to {a}{n} (at) site{n} (dot) com please"),
    ("email", "mail: {a}.{n} [at] mail.example [dot] org, thanks"),
    ("phone", "call me at (212) 555-{n} tonight"),
    ("phone", "phone: 0{k} 2555 {n}, office"),
    ("phone", "Tel. 415-555-{n} or"),
    ("ip", "server 2001:db8:0:0:0:ff00:{k}:{n} is up"),
    ("card", "visa card {card} expires"),
    ("card", "paid with {card} yesterday"),
]
LOOSE_FALSE = [
    "meet at noon.Then we {a} on",
    "it was looked at once.Nothing {a}",
    "released on 2024-01-1{d} by {a}",
    "since 1{d}.03.2021 the {a}",
    "at 12:3{d}:45 the {a}",
    "version 1.2.{n}.9999 of {a}",
    "order 4{n}.1234.1234.123{x} shipped",
    "isbn 978-3-16-14841{d}-0 by {a}",
    "a sum of 12.345.67{d} for {a}",
    "serial 9{n}1234567890{n} of {a}",
]


def filled(template, i, rng):
    digits = [4, *(rng.randrange(10) for _ in range(14))]
    last = next(d for d in range(10) if luhn("".join(map(str, (*digits, d)))))
    number = "".join(map(str, (*digits, last)))
    card = ".".join(number[k : k + 4] for k in range(0, 16, 4))
    bare = f"4{1000 + i}123412341" + "23"
    x = next(d for d in range(10) if not luhn(f"{bare[:13]}{d}"))
    return template.format(a=rng.choice(("anna", "joe", "marie", "karl")), n=1000 + i, k=30 + i % 60, d=i % 9, x=x, card=card)


def planted_spans(rng, each=40):
    """(text, kind or None) with one loose span each, true or not."""
    out = [(filled(t, i, rng), kind) for kind, t in LOOSE_TRUE for i in range(each)] + [(filled(t, i, rng), None) for t in LOOSE_FALSE for i in range(each)]
    base = [(f"reach {'abcdef'[i % 6]}{i}@mail{i}.example.com or +1 (212) 555-{1000 + i} from 10.0.{i % 250}.7, card 4111 1111 1111 1111", "base") for i in range(each)]
    return out + base


def test_added_spans_of_planted_texts(spark):
    rows = planted_spans(random.Random(3))
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: {pii.KINDS[s["kind"]] for s in r["spans"] if not s["base"]} for r in pii.find_personal_data(docs).collect()}
    met = {r["doc_id"]: r["n"] for r in docs.select("doc_id", F.size(F.filter(pii.candidates(F.col("text")), lambda x: ~x["base"])).alias("n")).collect()}
    true = [i for i, (_, k) in enumerate(rows) if k and k != "base"]
    false = [i for i, (_, k) in enumerate(rows) if k is None]
    caught = sum(rows[i][1] in got[i] for i in true)
    wrong = sum(bool(got[i]) for i in false)
    print("recall", caught / len(true), "precision", caught / (caught + wrong), "decoys met", sum(met[i] > 0 for i in false), "of", len(false))
    assert caught >= 0.9 * len(true) and caught >= 0.9 * (caught + wrong)
    assert sum(met[i] > 0 for i in false) > 0.5 * len(false)


def test_very_long_runs(spark):
    emails = " ".join(f"a{i}@b{i}.cc" for i in range(100_000))
    texts = ["7" * 10**6, "x@" + "a." * 10**5 + "b", emails, "1 " * 10**6, "1." * 10**6, "+1" + " " * 10**6, "é" * 10**6 + " 1.2.3.4", "ab at " * 10**5 + "c dot d", "0:" * 10**6, "12-34-" * 10**5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(len(texts))
    got = base_spans(spark, texts)  # as they must be: the plain patterns take quadratic time on these
    starts = [0, *itertools.accumulate(len(x) + 1 for x in emails.split(" "))][:-1]
    assert got[2] == [f"email:{at}:{at + len(x)}" for at, x in zip(starts, emails.split(" "), strict=True)]
    assert got[4] == [f"ip:{at}:{at + 7}" for at in range(0, 2 * 10**6, 8)]
    assert got[1] == [f"email:0:{len(texts[1])}"] and got[6] == [f"ip:{10**6 + 1}:{10**6 + 8}"]
    assert not any(got[i] for i in (0, 3, 5, 7, 8, 9))
    new = {r["doc_id"]: r["text"] for r in pii.redact(docs, length_col=None).collect()}
    assert new[2] == " ".join(["<EMAIL>"] * 100_000) and new[1] == "<EMAIL>" and new[6] == "é" * 10**6 + " <IP>"


@pytest.mark.parametrize("digits,ok", [("4111111111111111", True), ("4111111111111112", False), ("0000000000000", True)])
def test_luhn(spark, digits, ok):
    assert spark.range(1).select(pii.luhn(F.lit(digits))).first()[0] == ok


def test_redact(spark, awkward, empty):
    docs = spark.createDataFrame([(1, "é mail a@b.cc, 1.2.3.4 end", 26, "x"), (2, None, None, "y"), (3, "none", 4, None), (4, "+1 578 555 6437 a@b.cc", 22, "z")], "doc_id long, text string, n_chars long, spans string")
    got = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert got[1]["text"] == "é mail <EMAIL>, <IP> end" and got[1]["n_chars"] == 24 and got[1]["spans"] == "x"
    assert got[2]["text"] is None and got[2]["n_chars"] is None and got[3]["text"] == "none"
    assert got[4]["text"] == "<PHONE> <EMAIL>"
    assert pii.redact(awkward).exceptAll(awkward).count() == 0 and pii.redact(empty).count() == 0
    assert pii.find_personal_data(awkward).count() == awkward.count() and pii.find_personal_data(empty).count() == 0


def test_no_python_in_the_plan(sample):
    for df in (pii.find_personal_data(sample), pii.redact(sample)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
