"""URL filters against a plain evaluation."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from seriesmill.llm import urls

DAY = date(2024, 1, 1)


def on(n):
    return DAY + timedelta(days=n)


def brute(captures, entries):
    out = []
    for page, url, at in captures:
        keys = []
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host = rest[:end].split("@")[-1].split(":")[0].lower()
            path = rest[end:].split("?")[0].split("#")[0]
            labels = host.split(".")
            keys = [".".join(labels[i:]) for i in range(max(1, len(labels) - 1))] if host else []
            parts = [p for p in path.split("/") if p]
            keys += [host + "/" + "/".join(parts[: i + 1]) for i in range(len(parts))] if host else []
        hits = []
        for k in keys:
            days = {}
            for key, action, day in entries:
                if key == k and day is not None and at is not None and day <= at:
                    days.setdefault(day, set()).add(action)
            if days and days[max(days)] == {"add"}:
                hits.append(k)
        out.append((page, url, at, bool(hits), len(hits), min(hits, key=lambda k: (-len(k), k), default=None)))
    return sorted(out, key=str)


def run(spark, captures, entries):
    c = spark.createDataFrame(captures, "page_id long, url string, fetched date")
    e = spark.createDataFrame(entries, "key string, action string, at date")
    return sorted((tuple(r) for r in urls.filter_urls(c, e).collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(0)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "c.b.org", "co.uk"]
    paths = ["", "/", "/p", "/p/q", "//p//q/r", "/z?u=/p#k"]
    entries = [(rng.choice(hosts + [h + "/p" for h in hosts] + ["a.com/p/q"]), rng.choice(["add", "remove"]), on(rng.randrange(60))) for _ in range(80)]
    captures = [(i, f"https://{'me@' * (i % 7 == 0)}{rng.choice(hosts).upper() if i % 5 == 0 else rng.choice(hosts)}{':80' * (i % 3 == 0)}{rng.choice(paths)}", on(rng.randrange(70))) for i in range(300)]
    assert run(spark, captures, entries) == brute(captures, entries)


def test_awkward_rows(spark):
    captures = [(1, None, on(1)), (None, "http://a.com/", on(5)), (2, "http://a.com/", None), (3, "", on(1)), (3, "", on(1)), (4, "nonsense", on(2)), (5, "http:///x", on(2)), (6, "http://a.com/" + "d/" * 3000, on(5))]
    entries = [("a.com", "add", on(2)), ("a.com", "add", on(2)), (None, "add", on(1)), ("a.com", None, on(9)), ("a.com", "remove", None), ("nonsense", "add", on(1))]
    assert run(spark, captures, entries) == brute(captures, [e for e in entries if None not in e])
    assert run(spark, [], entries) == []
    assert all(not r[3] for r in run(spark, captures, []))


def test_validity(spark):
    rows = [("k", "add", on(3)), ("k", "add", on(5)), ("k", "remove", on(9)), ("k", "remove", on(12)), ("k", "add", on(20)), ("m", "remove", on(1)), ("n", "add", on(4)), ("n", "remove", on(4))]
    got = {r["key"]: (r["starts"], r["stops"]) for r in urls.validity(spark.createDataFrame(rows, "key string, action string, at date")).collect()}
    assert got == {"k": ([on(3), on(20)], [on(9), None])}


@pytest.mark.parametrize("n", [0, 1, 2, 7, 100])
def test_binary_search(spark, n):
    starts, stops = [3 * i for i in range(n)], [3 * i + 2 for i in range(n)]
    row = spark.createDataFrame([(starts, stops)], "a array<int>, b array<int>")
    got = row.select(*[urls.active(F.col("a"), F.col("b"), F.lit(v)) for v in range(-2, 3 * n + 3)]).first()
    assert list(got) == [0 <= v < 3 * n and v % 3 < 2 for v in range(-2, 3 * n + 3)]


def test_clashing_columns(spark):
    c = spark.createDataFrame([(1, "http://a.com", on(1), "x", "y")], "page_id long, url string, fetched date, key string, starts string")
    e = spark.createDataFrame([("a.com", "add", on(0), "z")], "key string, action string, at date, page_id string")
    assert urls.filter_urls(c, e).first()["blocked"]


def test_addresses_and_final_dots(spark):
    captures = [(1, "http://[2001:db8::1]:80/x", on(5)), (2, "http://A.com./P", on(5)), (3, "http://a.com/p", on(5)), (4, "http://[::1.2.3.4]/", on(5))]
    entries = [("[2001:db8::1]", "add", on(1)), ("a.com/P", "add", on(1)), ("3.4]", "add", on(1))]
    assert [(r[0], r[3], r[5]) for r in run(spark, captures, entries)] == [(1, True, "[2001:db8::1]"), (2, True, "a.com/P"), (3, False, None), (4, False, None)]
