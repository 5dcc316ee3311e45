"""Quality rules as a short-circuit cascade, in DataFrame functions.

Each rule owns its measure of the text, which is computed only when the rule is reached. Each rule's cost (time per row, over
the time of a job without a rule) and selectivity (share of rows it rejects) are measured on a bounded sample; rules then run
in the order of rejection per cost, as one conditional expression that stops at the first rule that rejects.
"""

from __future__ import annotations

import math
import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, SPACES, materialize, word_count

WINDOW = 5
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """reject: SQL over the text (`text`) and the measures of `measured`."""

    name: str
    reject: str


def _left(kept: str) -> str:
    """SQL for the number of the text's code points in a class, which is taken for all others to be removed."""
    return f"length(regexp_replace(text, r'[^{kept}]++', ''))"


#: Beyond the base rules (fewer than 10 words; over 20 % of words in repeated windows). Ratios are written as products.
BASE_RULES = (Rule("few_words", "n_words < 10"), Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"))
RULES = (
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 25 * n_words"),
    Rule("symbols", "5 * n_symbols > n_words"),
    Rule("duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule("letters", rf"2 * {_left(r'\p{L}')} < word_chars"),
    Rule("shouting", rf"2 * {_left(r'\p{Lu}')} > word_chars"),
    Rule("code_marks", r"20 * regexp_count(text, r'[{}\;=~^]') > word_chars"),
    Rule("ellipsis_lines", r"10 * regexp_count(text || '\n', r'(?:[.]{3}|…)[\x20\x09\x0D]*+\n') > 3 * n_lines"),
    Rule("bullet_lines", r"10 * regexp_count('\n' || text, r'\n[\x20\x09]*+[-*•]\x20') > 9 * n_lines"),
)


def repeated_words(text: Column, window: int = WINDOW) -> Column:
    """Number of words that lie in windows of so many words that occur twice or more in the text, the first included."""
    words = F.split(F.btrim(text, F.lit(SPACES)), f"[{SPACE_CLASS}]+", -1)
    zero = F.lit(0).cast("long")

    def covered(places: Column) -> Column:
        gain = F.transform(places, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(places, k + 1) - p, F.lit(window))))
        return F.aggregate(gain, zero, lambda a, x: a + x)

    def counted(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            marked = F.transform(s, lambda p, k: F.when(p["h"].eqNullSafe(F.get(s, k - 1)["h"]) | p["h"].eqNullSafe(F.get(s, k + 1)["h"]), p["i"]))
            places = F.sort_array(F.filter(marked, lambda p: p.isNotNull()))
            return F.get(F.transform(F.array(places), covered), F.lit(0))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), zero).otherwise(F.get(F.transform(F.array(pairs), twice), F.lit(0)))

    def hashed(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(window)]))
        return F.when(F.size(w) > window, F.get(F.transform(F.array(hashes), counted), F.lit(0))).otherwise(zero)

    return F.coalesce(F.get(F.transform(F.array(words), hashed), F.lit(0)), zero)


def _lines(text: Column) -> Column:
    """(n_lines, n_dup_lines): lines with a word, and those of them that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))
    both = lambda a: F.struct(F.size(a).cast("long").alias("n_lines"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"))
    return F.get(F.transform(F.array(lines), both), F.lit(0))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, text, n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of every whole text; null: empty."""
    own = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = own.select(
        id_col,
        "text",
        word_count(F.col("text")).alias("n_words"),
        F.length(F.regexp_replace("text", f"[{SPACE_CLASS}]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        _lines(F.col("text")).alias("_lines"),
        repeated_words(F.col("text")).alias("n_repeat_words"),
    )
    return out.select(id_col, "text", "n_words", "word_chars", "n_symbols", "_lines.n_lines", "_lines.n_dup_lines", "n_repeat_words")


def cascade_order(sample: DataFrame, rules: Sequence[Rule], repeats: int = 3, copies: int = 1) -> list[tuple[Rule, float, float]]:
    """rules with their measured cost (seconds a row) and selectivity on sample, by rejection per cost, falling; ties by name.

    Each row counts copies times, so that a small sample gives times that can be told from a job's own; of so many repeats the
    shortest counts, less that of a job which only reads the text. Rules are timed in turns: a slow moment meets them all.
    """
    rows = sample.select("*", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("_copy")) if copies > 1 else sample
    # the copy's number goes into the text, so that no copy's result can stand for another's
    rows = rows.withColumn("text", F.concat("text", F.lit(" "), F.col("_copy").cast("string"))) if copies > 1 else rows
    n = max(1, sample.count())
    tests = {"": "length(text) < 0"} | {r.name: r.reject for r in rules}
    least, hits = dict.fromkeys(tests, math.inf), {}
    for _ in range(repeats):
        for name, reject in tests.items():
            begun = time.perf_counter()
            rows.agg(F.count_if(F.coalesce(F.expr(reject), F.lit(False)))).first()
            least[name] = min(least[name], time.perf_counter() - begun)
    if rules:
        got = sample.agg(*[F.count_if(F.coalesce(F.expr(r.reject), F.lit(False))).alias(f"h{i}") for i, r in enumerate(rules)]).first()
        hits = {r.name: got[i] for i, r in enumerate(rules)}
    # what can't be told from nothing still costs something: a hundredth of a microsecond
    found = [(r, max((least[r.name] - least[""]) / (n * copies), 1e-8), hits[r.name] / n) for r in rules]
    return sorted(found, key=lambda x: (-x[2] / x[1], x[0].name))


def verdict(rules: Sequence[Rule]) -> Column:
    """The name of the first rule that rejects, null if none does; rules after it aren't evaluated."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(F.coalesce(F.expr(rule.reject), F.lit(False)), F.lit(rule.name)).otherwise(out)
    return out


def expected_cost(order: Sequence[tuple[Rule, float, float]]) -> float:
    """Seconds a row of rules in this order, were they independent: each costs as often as none before it rejects."""
    total, left = 0.0, 1.0
    for _, cost, share in order:
        total, left = total + left * cost, left * (1 - share)
    return total


def cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measures of every row, base_failed, kept, and rejected_by (the first base rule or rule that rejects; null if kept).

    The order of rules depends on timings, the verdict kept doesn't. rejected_by names a base rule first. Rules are timed on
    about sample_rows rows that the base rules let pass, as those are what rules meet. Null texts count as empty and fail;
    texts of any length are measured whole; repeated rows and ids give a row each; an empty table gives an empty result;
    other columns, whatever their names, are ignored.
    """
    n = docs.count()
    some = docs.where(F.rand(7) < min(1.0, sample_rows / max(1, n)))
    base = verdict(BASE_RULES)
    sample = materialize(measured(some, id_col, text_col).where(base.isNull()), "quality")
    order = [r for r, *_ in cascade_order(sample, rules, copies=3)]
    out = measured(docs, id_col, text_col).withColumn("rejected_by", F.coalesce(base, verdict(order)))
    failed = F.coalesce(F.col("rejected_by").isin([r.name for r in BASE_RULES]), F.lit(False))
    return out.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"), "rejected_by")
