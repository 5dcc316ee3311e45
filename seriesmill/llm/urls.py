"""URL filters by temporal list join: dated list entries become validity intervals, met by an as-of join at fetch time.

Entries are (key, action, at): a key is a host, which covers its subdomains, or a host with a path, which covers what lies
below it; action is add or remove. Per key the entries become rising, disjoint intervals [start, stop), kept as two arrays;
a capture meets each of its keys at most once and finds the interval that may hold its time by binary search.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A URL's host without user and port, and its path without query and fragment.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^/?#\]]*\]|[^/?#:]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host(url: Column) -> Column:
    """The host in lower case, without the dot that may end it; an IPv6 address with its brackets; "" if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"[.]\z", "")


def host_keys(name: Column) -> Column:
    """The host and its parent domains of two labels or more; an address in brackets alone; an empty array for no host."""
    return F.get(
        F.transform(
            F.array(F.split(name, r"\.", -1)),
            lambda p: F.when(F.length(name) == 0, F.array().cast("array<string>"))
            .when((F.size(p) < 3) | name.startswith("["), F.array(name))
            .otherwise(F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.array_join(F.slice(p, i, F.size(p)), "."))),
        ),
        F.lit(0),
    )


def path_keys(name: Column, path: Column, depth: int) -> Column:
    """host/a, host/a/b and so on, down to depth segments."""
    segments = F.slice(F.filter(F.split(path, "/", -1), lambda s: F.length(s) > 0), F.lit(1), F.lit(max(depth, 1)))
    none = F.array().cast("array<string>")
    if depth < 1:
        return none
    one = lambda s: F.when((F.length(name) > 0) & (F.size(s) > 0), F.transform(F.sequence(F.lit(1), F.size(s)), lambda i: F.concat(name, F.lit("/"), F.array_join(F.slice(s, F.lit(1), i), "/")))).otherwise(none)
    return F.get(F.transform(F.array(segments), one), F.lit(0))


def validity(entries: DataFrame) -> DataFrame:
    """(key, starts, stops) of (key, action, at): intervals from an add to the next remove; stop is null while it holds.

    Entries at one time take effect together: a removal then has the last word. Entries with a null are ignored.
    """
    clean = entries.where("key is not null and action in ('add', 'remove') and at is not null")
    at_once = clean.groupBy("key", "at").agg(F.max("action").alias("action"))  # remove > add
    by = Window.partitionBy("key").orderBy("at")
    changes = at_once.withColumn("was", F.lag("action").over(by)).where("was is null and action = 'add' or was <> action")
    spans = changes.withColumn("stop", F.lead("at").over(by)).where("action = 'add'")
    pairs = spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(F.col("at").alias("start"), "stop"))).alias("v"))
    return pairs.select("key", F.col("v.start").alias("starts"), F.col("v.stop").alias("stops"))


def active(starts: Column, stops: Column, at: Column) -> Column:
    """Whether at lies in one of the intervals: the last start up to at, by binary search, and its stop."""
    halves = F.array(*[F.lit(1 << i) for i in reversed(range(31))])
    last = F.aggregate(halves, F.lit(-1), lambda k, s: F.when((k + s < F.size(starts)) & (F.get(starts, k + s) <= at), k + s).otherwise(k))
    return F.coalesce((last >= 0) & (F.get(stops, last).isNull() | (at < F.get(stops, last))), F.lit(False))


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", at_col: str = "fetched") -> DataFrame:
    """(id_col, url_col, at_col, blocked, n_matches, matched) for every row of captures: what the list said when it was fetched.

    n_matches counts the capture's keys that were listed then; matched is the longest of them, the first in order among
    those. A null or hostless URL and a null time match nothing. Keys are met as they stand: hosts in lower case and without
    a final dot, paths by case, an IPv6 address in brackets as one host. Repeated rows give a row each, other columns are
    ignored. A hot host's captures are one side of a join whose other side has a row per key, so they can be split.
    """
    lists = validity(entries)
    depth = entries.agg(F.max(F.size(F.split("key", "/")) - 1)).first()[0] or 0
    rows = captures.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(at_col).alias("_at"))
    keyed = rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_host", F.coalesce(host(F.col("_url")), F.lit("")))
    path = F.coalesce(F.regexp_extract("_url", PATH, 1), F.lit(""))
    each = keyed.withColumn("_key", F.explode_outer(F.concat(host_keys(F.col("_host")), path_keys(F.col("_host"), path, depth)))).drop("_host")
    met = each.join(lists, each["_key"] == lists["key"], "left")
    hit = F.col("key").isNotNull() & active(F.col("starts"), F.col("stops"), F.col("_at"))
    met = met.select("_row", "_id", "_url", "_at", F.when(hit, F.col("_key")).alias("_hit"))
    best = F.min(F.when(F.col("_hit").isNotNull(), F.struct((-F.length("_hit")).alias("n"), F.col("_hit").alias("k"))))
    out = met.groupBy("_row").agg(F.first("_id").alias(id_col), F.first("_url").alias(url_col), F.first("_at").alias(at_col), F.count("_hit").alias("n_matches"), best.alias("_best"))
    return out.select(id_col, url_col, at_col, (F.col("n_matches") > 0).alias("blocked"), "n_matches", F.col("_best.k").alias("matched"))
