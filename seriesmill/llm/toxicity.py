"""Toxicity by misspelling-tolerant lexicon matching.

A lexicon of words and word beginnings is learned from labelled documents. Its trie is intersected with Levenshtein automata
of all its terms at once: a state is a set of (trie node, errors left), computed on demand and kept, so a word is one walk
over a table and most words end after a few letters. Around each hit a window of words tells quotation and report from
abuse, and a logistic model over the hits' counts gives the score.

Labelled documents alone would teach the model little of misspelling and quotation. So each toxic one that has terms is
joined by two made from it: one with the terms misspelt, which is as toxic, and one that only quotes them, which isn't.
Hits, misspelt ones included, can't lower a score. Words near a term that other documents use as well aren't misspellings.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, python_workers

_STRIP = "\"'`.,;:!?()[]{}<>«»„“”‚‘’…*_~-–—"
_QUOTES = "\"«»„“”"
_LONG_QUOTE = re.compile("[" + _QUOTES + "]")
#: Words before a term that report or mention it, and words that address someone.
REPORT = frozenset("said says called calls wrote writes quote quoted term word named dit appelé mot sagte nannte wort dijo llamó palabra".split())
ADDRESS = frozenset("you your you're u ur du dein deine ihr tu toi ton ta vous votre usted eres tú tus are".split())
WINDOW = 6
#: Lengths of the word beginnings that may become terms.
BEGINNINGS = (4, 5, 6, 7)
FEATURES = ("exact", "fuzzy", "prefix", "quoted", "addressed", "density")


@dataclass(frozen=True)
class Term:
    """A word of the lexicon, or (with rest) the beginning of words."""

    text: str
    rest: bool = False

    @property
    def errors(self) -> int:
        return 0 if self.rest or len(self.text) < 5 else 1 if len(self.text) < 10 else 2


class Matcher:
    """The lazily determinised intersection of the Levenshtein automata (adjacent swaps count once) with the trie of terms."""

    DEAD = -1

    def __init__(self, terms: list[Term], known: int = 200_000, ordinary: Iterable[str] = ()):
        self.ordinary = frozenset(ordinary)
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[Term]] = [[]]
        self.room: list[int] = [0]  # errors that some term below allows
        for t in terms:
            node = 0
            for c in t.text:
                self.room[node] = max(self.room[node], t.errors)
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.room.append(0)
                node = self.children[node][c]
            self.room[node] = max(self.room[node], t.errors)
            self.ends[node].append(t)
        self.states: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.accepts: list[int] = []  # 0 none, 1 exact, 2 fuzzy, 3 beginning
        self.known, self.cache = known, {}
        self.start = self._state(self._closed({(0, 0, "")}))

    def _closed(self, items: set) -> frozenset:
        """With what skipped letters of terms reach; items are (node, errors so far, letter due after a swap)."""
        todo, out = list(items), set()
        while todo:
            node, e, due = item = todo.pop()
            if item in out:
                continue
            out.add(item)
            if not due and node >= 0:
                todo += [(k, e + 1, "") for k in self.children[node].values() if e + 1 <= self.room[k]]
        best: dict[tuple, int] = {}
        for node, e, due in out:
            best[node, due] = min(e, best.get((node, due), 9))
        return frozenset((n, e, d) for (n, d), e in best.items())

    def _state(self, items: frozenset) -> int:
        if not items:
            return self.DEAD
        if items not in self.number:
            self.number[items] = len(self.states)
            self.states.append(items)
            self.moves.append({})
            kinds = [3 if n < 0 else 1 if e == 0 else 2 for n, e, d in items if n < 0 or (not d and any(e <= t.errors and not t.rest for t in self.ends[n]))]
            self.accepts.append(min(kinds, default=0))
        return self.number[items]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, e, due in self.states[state]:
            if node < 0:
                out.add((-1, 0, ""))
                continue
            if due:
                if c == due:
                    out.add((node, e, ""))
                continue
            kids = self.children[node]
            if c in kids:
                k = kids[c]
                out.add((k, e, ""))
                if e == 0 and any(t.rest for t in self.ends[k]):
                    out.add((-1, 0, ""))
            if e + 1 <= self.room[node]:
                out.add((node, e + 1, ""))
                for d, k in kids.items():
                    if d != c and e + 1 <= self.room[k]:
                        out.add((k, e + 1, ""))
                        if c in self.children[k]:
                            out.add((self.children[k][c], e + 1, d))
        self.moves[state][c] = to = self._state(self._closed(out))
        return to

    def match(self, word: str) -> int:
        """0: no term; 1: a term; 2: a term misspelt (and no ordinary word); 3: a word with a term's beginning."""
        found = self.cache.get(word)
        if found is None:
            s, moves = self.start, self.moves
            for c in word:
                to = moves[s].get(c)
                s = self._step(s, c) if to is None else to
                if s < 0:
                    break
            found = 0 if s < 0 else self.accepts[s]
            if found == 2 and word in self.ordinary:
                found = 0
            if len(self.cache) >= self.known:
                self.cache.clear()
            self.cache[word] = found
        return found


def features(text: str, matcher: Matcher) -> list[float]:
    """FEATURES of a text: hits as logarithms of weighted counts, quotations counted apart."""
    words = text.lower().split()
    exact = fuzzy = prefix = quoted = addressed = 0.0
    match, quotes, seen_to = matcher.match, 0, 0
    for i, raw in enumerate(words):
        w = raw.strip(_STRIP)
        kind = match(w) if w else 0
        if not kind and raw != w:
            kind = match(raw)
        if not kind:
            continue
        quotes += sum(len(_LONG_QUOTE.findall(x)) for x in words[seen_to:i])  # marks before the hit
        seen_to = i
        around = words[max(0, i - WINDOW) : i + WINDOW + 1]
        inside = (raw[0] in _QUOTES + "'" and raw[-1] in _QUOTES + "'.,;!?") or (quotes % 2 == 1 and any(c in x for x in around for c in _QUOTES))
        reported = any(x.strip(_STRIP) in REPORT for x in around[: min(WINDOW, i)])
        if inside or reported:
            quoted += 1
            continue
        exact += kind == 1
        fuzzy += kind == 2
        prefix += kind == 3
        addressed += any(x.strip(_STRIP) in ADDRESS for x in around)
    hits = exact + fuzzy + prefix
    return [math.log1p(exact), math.log1p(fuzzy), math.log1p(prefix), math.log1p(quoted), math.log1p(addressed), 100 * hits / (len(words) + 20)]


@dataclass(frozen=True)
class Model:
    terms: tuple[Term, ...]
    weights: tuple[float, ...]  # constant, then FEATURES
    ordinary: tuple[str, ...] = ()

    def matcher(self) -> Matcher:
        return Matcher(list(self.terms), ordinary=self.ordinary)

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self.weights[0] + x @ np.array(self.weights[1:])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


#: Features that can't lower a score, and the one that can't raise it.
_RAISE, _LOWER = ("exact", "fuzzy", "prefix", "addressed", "density"), ("quoted",)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3, rounds: int = 40) -> tuple[float, ...]:
    """Weights, the constant first, of a penalised logistic regression by Newton's method, with the signs that features may
    have: what comes out with the wrong sign is left out, and the others are fitted again."""
    sign = np.array([f in _RAISE for f in FEATURES]) * 1.0 - np.array([f in _LOWER for f in FEATURES])
    used, share = np.ones(len(FEATURES), bool), weight / weight.sum()
    while True:
        a = np.c_[np.ones(len(x)), x[:, used]]
        w = np.zeros(a.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            h = (a * (share * p * (1 - p))[:, None]).T @ a + penalty * np.eye(len(w))
            step = np.linalg.solve(h, a.T @ (share * (p - y)) + penalty * w)
            w = w - step
            if np.abs(step).max() < 1e-6:
                break
        full = np.zeros(len(FEATURES))
        full[used] = w[1:]
        if not (wrong := used & (full * sign < 0)).any():
            return float(w[0]), *map(float, full)
        used &= ~wrong


#: Least hashes kept of a sampled text. Texts that share half of their word triples share one of them in all but 0.4 % of cases.
MARKS = 8


def _signature(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, toxic, text and, under MARKS orders, the least hash of the text's word triples: copies and near copies share some."""
    import xxhash

    for b in batches:
        marks = []
        for t in b.column(2).to_pylist():
            w = (t or "").lower().split()
            h = np.array([xxhash.xxh64_intdigest(" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))], np.uint64)
            marks.append([int(((h ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)).min() >> np.uint64(1)) for k in range(MARKS)])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(marks, pa.list_(pa.int64()))], ["id", "toxic", "text", "marks"])


def first_copies(rows: Iterable[tuple[int, list[int]]]) -> list[int]:
    """Of ids with marks, the least id of each group that shared marks connect."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    ids = []
    for i, marks in rows:
        ids.append(i)
        for k, m in enumerate(marks):
            parent[root((k, m))] = root(i)
    least: dict = {}
    for i in ids:
        r = root(i)
        least[r] = min(i, least.get(r, i))
    return sorted(least.values())


def _beginnings(words: Column, k: int) -> Column:
    """The first k letters of longer words, each with a star."""
    return F.transform(F.filter(words, lambda w: F.length(w) > k), lambda w: F.concat(F.left(w, F.lit(k)), F.lit("*")))


def learn_terms(sample: DataFrame, chance: float = 0.01, log_odds: float = 3.0) -> list[Term]:
    """Words and word beginnings (4 to 7 letters) of (toxic, text) that speak for the label; near copies should be in it once.

    A term's share of the toxic texts must exceed its share of the others by log_odds, and its likelihood-ratio statistic
    must be so great that of all terms that are tested none passes by chance, but with that probability. A term that is met
    without those chosen before must speak for the label there too: words that only go with others aren't terms. No number
    of terms is set; the sample bounds them.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{3,40})"), F.lit(1)))
    begun = [_beginnings(words, k) for k in BEGINNINGS]
    rows = sample.select("toxic", F.monotonically_increasing_id().alias("row"), F.array_distinct(F.concat(words, *begun)).alias("terms"))
    total = sample.agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).first()
    bad, good = int(total["bad"] or 0), int((total["n"] or 0) - (total["bad"] or 0))
    if not bad or not good:
        return []
    terms = rows.select("toxic", "row", F.explode("terms").alias("term"))
    counts = materialize(terms.groupBy("term").agg(F.sum("toxic").alias("pos"), F.count("*").alias("n")).where("pos > 2"), "terms")
    evidence = 2 * math.log(max(1, counts.count()) / chance)  # for one degree of freedom, exp(-x / 2) bounds the chance
    odds = F.log((F.col("pos") + 0.5) / (bad + 1.0)) - F.log((F.col("n") - F.col("pos") + 0.5) / (good + 1.0))
    q, p = bad / (bad + good), F.col("pos") / F.col("n")
    ratio = 2 * (F.col("pos") * F.log(p / q) + F.when(p < 1, (F.col("n") - F.col("pos")) * F.log((1 - p) / (1 - q))).otherwise(0.0))
    top = counts.where((odds > log_odds) & (ratio > evidence)).select(F.col("term").alias("t"), "pos")
    held = terms.join(top, terms["term"] == top["t"]).groupBy("t", "pos").agg(F.sort_array(F.collect_list(F.struct("row", "toxic"))).alias("rows")).collect()
    held = sorted(held, key=lambda r: (-r["pos"], r["t"]))
    pos = {r["t"]: r["pos"] for r in held}
    chosen: list[Term] = []
    met: set[int] = set()
    for r in held:
        t = r["t"]
        beginnings = [t[:k] + "*" for k in BEGINNINGS if len(t.rstrip("*")) > k or (t.endswith("*") and len(t) - 1 > k)]
        if any(b in pos and pos[b] >= r["pos"] and Term(b[:-1], True) in chosen for b in beginnings):
            continue  # a chosen beginning has it
        if t.endswith("*"):
            # a beginning counts if it gathers more than its commonest word does
            own = max((p for w, p in pos.items() if not w.endswith("*") and w.startswith(t[:-1])), default=0)
            if own >= 0.8 * r["pos"]:
                continue
        alone = [x["toxic"] for x in r["rows"] if x["row"] not in met]
        if len(alone) >= 3 and sum(alone) < 0.5 * len(alone):
            continue
        chosen.append(Term(t.rstrip("*"), t.endswith("*")))
        met.update(x["row"] for x in r["rows"])
    return chosen


def misspelt(word: str) -> str:
    """word with one letter after the first left out, doubled, swapped with the next or masked, as a hash of it says."""
    h = zlib.crc32(word.encode())
    at, how = 1 + h // 7 % max(1, len(word) - 2), h % 4
    return (word[:at] + word[at + 1 :], word[:at] + word[at] + word[at:], word[:at] + word[at + 1 : at + 2] + word[at] + word[at + 2 :], word[:at] + "*" + word[at + 1 :])[how]


def contrasts(text: str, matcher: Matcher) -> list[tuple[int, str]]:
    """What a toxic text gives besides itself: (1, the text with its terms misspelt) and (0, the text quoting them)."""
    bad, quoting, hits, wrong = [], [], 0, 0
    for raw in text.split():
        w = raw.strip(_STRIP)
        if w and matcher.match(w.lower()) == 1:
            hits += 1
            other = misspelt(w)
            wrong += matcher.match(other.lower()) == 2
            bad.append(raw.replace(w, other))
            quoting += ["the", "word", raw.replace(w, f'"{w}"')]
        else:
            bad.append(raw)
            quoting.append(raw)
    return ([(1, " ".join(bad))] if hits and wrong == hits else []) + ([(0, " ".join(quoting))] if hits else [])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from at most about sample_rows labelled documents, none of which is held out (crc32 of the id, modulo 4, is 2).

    The sample is drawn by a hash of the id, so reruns agree. Of near copies in it one counts. Without toxic and other rows
    in it, every score is their share. Null ids and labels are left out; an id with several labels has the greatest.
    """
    python_workers(docs.sparkSession)
    held = F.crc32(F.col(id_col).cast("string")) % 4 == 2
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held)
    n = usable.count()
    keep = F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(1 << 20)) < math.ceil(min(1.0, sample_rows / max(1, n)) * (1 << 20))
    chosen = usable.where(keep).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).where(F.col("doc").isNotNull())
    picked = rows.join(F.broadcast(chosen), rows["doc"] == chosen["id"]).select(F.col("id").cast("long"), "toxic", F.coalesce("text", F.lit("")).alias("text"))
    marked = materialize(picked.mapInArrow(_signature, "id long, toxic int, text string, marks array<long>"), "sample")
    firsts = first_copies((r["id"], r["marks"]) for r in marked.select("id", "marks").collect())
    once = docs.sparkSession.createDataFrame([(i,) for i in firsts], "first long")
    one = marked.join(F.broadcast(once), marked["id"] == once["first"]).groupBy("id").agg(F.max("toxic").alias("toxic"), F.max("text").alias("text"))
    one = materialize(one, "once")
    terms = learn_terms(one)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Matcher(terms)
        for b in batches:
            found: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for toxic, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w in {raw.strip(_STRIP) for raw in t.lower().split()}:
                    if w and own.match(w) == 2:
                        found[w][toxic] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *(pa.array([v[k] for v in found.values()], pa.int64()) for k in (0, 1))], ["word", "others", "toxic"])

    words = one.select("toxic", "text").mapInArrow(near, "word string, others long, toxic long").groupBy("word").agg(F.sum("others").alias("others"), F.sum("toxic").alias("toxic"))
    ordinary = tuple(sorted(r["word"] for r in words.where("others > 0 and others >= toxic").collect()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Matcher(terms, ordinary=ordinary)
        for b in batches:
            got = []
            for toxic, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got += [(toxic, features(t, own)), *((y, features(c, own)) for y, c in (contrasts(t, own) if toxic else ()))]
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in got], pa.int32()), pa.array([x for _, x in got], pa.list_(pa.float64()))], ["toxic", "x"])

    got = one.select("toxic", "text").mapInArrow(run, "toxic int, x array<double>").groupBy("toxic", "x").count().collect()
    if not got:
        return Model(tuple(terms), (-5.0, *[0.0] * len(FEATURES)))
    x, y, c = np.array([r["x"] for r in got]), np.array([r["toxic"] for r in got], float), np.array([r["count"] for r in got], float)
    order = np.lexsort([*x.T, y])
    return Model(tuple(terms), logistic(x[order], y[order], c[order]), ordinary)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, *keep, toxicity: double) for every row; null and empty texts have no hits and score as such."""
    python_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher()
        for b in batches:
            x = np.array([features(t.as_py() or "", matcher) for t in b.column(0)], float).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(model.scores(x))], [*b.schema.names[1:], "toxicity"])

    columns = [F.col(c) for c in dict.fromkeys((id_col, *keep))]
    picked = docs.select(F.col(text_col).cast("string").alias("_scored_text"), *columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[1:]) + ", toxicity double"
    return picked.mapInArrow(run, schema)


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """docs without the rows that score threshold or more; columns stay as they are.

    Null and empty texts have no hits and stay; repeated rows stay or go together; an empty table gives an empty one.
    """
    python_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher()
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col))
            x = np.array([features(str(t.as_py() or ""), matcher) for t in texts], float).reshape(b.num_rows, len(FEATURES))
            yield b.filter(pa.array(model.scores(x) < threshold))

    return docs.mapInArrow(run, docs.schema)
