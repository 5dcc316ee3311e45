"""Personal data by weak supervision, in DataFrame functions alone.

Candidate spans come from strict patterns (base spans, always kept) and from loose ones, which also meet dates, versions,
times, order numbers and phrases. Labelers (written forms, checksums, gazetteers, cue words in the 24 characters before a
span, neighbouring characters) vote for a candidate, against it or not at all, whichever pattern found it. Candidates are
counted by kind, votes and features of the span, a table of at most 144 * 2^9 rows a kind whatever the corpus. Over it
expectation-maximisation estimates how each labeler votes on personal data and on other things, and a logistic span
classifier is trained on the posteriors, from the votes and the features together. Its weights become one expression, which
decides about the loose candidates.

All patterns are possessive or bounded, positions are prefix sums by doubling and overlaps binary searches, so that texts
of millions of digits, labels or spans take neither stack nor quadratic time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("email", "ip", "card", "phone")
#: Base patterns. The lookarounds start a match only where a run of its first characters starts, or where the
#: match before ended; later starts in a run can't match if its first start doesn't. So no text takes quadratic time.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Loose patterns: spelt-out addresses and those without a top-level domain; addresses with colons and quads out of range;
#: runs of 13 to 19 digits, whatever their check digit and separators; groups of digits without a plus.
_AT, _DOT = r"(?:\x20?[\[({]\x20?(?:at|AT)\x20?[\])}]\x20?|\x20at\x20)", r"(?:\x20?[\[({]\x20?(?:dot|DOT)\x20?[\])}]\x20?|\x20dot\x20|\.)"
LOOSE = {
    "email": rf"(?<![{_LOCAL}@])[{_LOCAL}]{{1,64}}(?:{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,8}}+|@[A-Za-z0-9-]{{1,63}})(?![A-Za-z0-9@-])",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}|[0-9]{1,4}(?:\.[0-9]{1,4}){3})(?![0-9A-Za-z:.])",
    "card": r"(?<![0-9A-Za-z._/-])[0-9](?:[\x20._/-]?[0-9]){12,18}(?![0-9A-Za-z_/-])",
    "phone": r"(?<![0-9A-Za-z+(._/-])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,5}[\x20./-])[0-9]{2,4}(?:[\x20./-][0-9]{2,4}){1,3}(?![0-9A-Za-z_/-])",
}
#: What a text must contain for a pattern to be tried at all.
_HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
_LOOSE_HINT = {"email": rf"@|{_AT}[A-Za-z0-9-]++{_DOT}", "ip": r"[0-9A-Fa-f:]:[0-9A-Fa-f]{0,4}:|[0-9]\.[0-9]{1,4}\.[0-9]", "card": r"[0-9](?:[\x20._/-]?[0-9]){12}", "phone": r"[0-9)][\x20./-]?[0-9]{2,4}[\x20./-][0-9]{2}"}
#: Gazetteers: top-level domains, leading digits of card issuers, country calling codes of one digit or two, words that stand
#: before an "at" which is no address.
TLDS = "com|org|net|edu|gov|mil|int|info|biz|io|co|uk|de|fr|es|it|nl|be|ch|at|pl|pt|se|no|fi|dk|ie|eu|us|ca|au|nz|jp|cn|in|br|mx|ru|za|kr|tr|ar|cz|gr|hu|il|ro|ua|example|test|local"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)"
CALLING = r"^(?:00)?(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
PROSE = r"(?i)^(?:is|was|are|were|be|look|looked|arrive|arrived|meet|met|end|ended|start|started|it|them|him|her|us|me|not|and|or|the|all|up|only|even|live|lives|lived|work|works|stay|held)\x20at\x20"
#: Cue words, by kind, and cues that speak of something else.
CUES = {
    "email": r"(?i)(?:mail|contact|kontakt|write|correo|courriel|adresse?|reply|reach|from|to)\W{0,3}(?:(?:me|us|is|at)\W{0,2})?$",
    "ip": r"(?i)(?:\bip\b|ipv6|server|host|address|addr|client|gateway|from)\W{0,3}$",
    "card": r"(?i)(?:card|visa|mastercard|carte|karte|tarjeta|pan|credit|paid\x20with)\W{0,3}(?:no|nr|number)?\W{0,3}$",
    "phone": r"(?i)(?:phone|tel|telefon|call|mobile|fax|cell|handy|whatsapp|sms|t[eé]l[eé]phone)\W{0,3}(?:(?:me|us|at|is|on)\W{0,2})?$",
}
AGAINST = r"(?i)(?:version|isbn|issn|ean|order|invoice|token|password|sha|md5|ref|serial|build|release|chapter|section|date|on|since|until|time|score|at|tracking|part|v|\bid\b|\bno)\W{0,4}$"
_DATE = r"^(?:(?:19|20)[0-9]{2}[./\x20-][01]?[0-9][./\x20-][0-3]?[0-9]|[0-3]?[0-9][./\x20-][01]?[0-9][./\x20-](?:19|20)[0-9]{2})(?:[\x20]|$)"
#: Written forms, by kind: of the kind itself and of other things.
FORMS = {
    "email": (r"@.*\.[A-Za-z]{2,}$|[\[({]\x20?(?:at|AT)", r"\x20at\x20[^.]*\.[A-Z]|@[^.]*$"),
    "ip": (r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$|^[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}$|::", r"^[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?:?$|^:*$|^(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}$"),
    "card": (r"^[0-9]{4}([\x20._-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}$|^3[0-9]{3}([\x20._-]?)[0-9]{6}\2[0-9]{5}$", r"^97[89][\x20-]?[0-9]|^[0-9]{4}[./-][01][0-9][./-]|(.)\3{9}"),
    "phone": (r"^\+|^00|^\([0-9]{2,4}\)|^0[0-9]{2,4}[\x20/.-]|^[2-9][0-9]{2}[\x20.-][2-9][0-9]{2}[\x20.-][0-9]{4}$", _DATE + r"|^[0-9]{1,3}(?:[.][0-9]{3})+$|^97[89]"),
}
LABELERS = ("form", "check", "gazetteer", "cue", "other", "edge")
FEATURES = ("usual_size", "one_separator", "grouped", "after_colon", "leading_zero", "few_digits", "digits_near", "upper_near", "unseparated")
_CANDIDATE = "struct<kind:int,start:int,stop:int,base:boolean,votes:array<int>,features:array<int>>"


def scan(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """The running fold of an array by an associative function, in as many passes as its size has binary digits."""
    two = lambda k: F.call_function("shiftleft", F.lit(1), k)
    passes = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))
    return F.aggregate(passes, values, lambda acc, k: F.transform(acc, lambda x, i: F.when(i >= two(k), combine(F.get(acc, i - two(k)), x)).otherwise(x)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _matches(text: Column, pattern: str, hint: str) -> Column:
    """array<struct<start, stop, span, before, after>> of a pattern's matches, in code points; empty where the hint is missing."""
    none = F.array().cast("array<struct<start:int,stop:int,span:string,before:string,after:string>>")

    def placed(b: Column) -> Column:
        spans, gaps = b["s"], b["g"]
        ends = scan(F.transform(spans, lambda s, i: F.length(F.get(gaps, i)) + F.length(s)), lambda x, y: x + y)

        def rows(stops: Column) -> Column:
            return F.transform(
                spans,
                lambda s, i: F.struct(
                    (F.get(stops, i) - F.length(s)).alias("start"), F.get(stops, i).alias("stop"), s.alias("span"),
                    F.right(F.get(gaps, i), F.lit(24)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(2)).alias("after"),
                ),
            )

        return F.when(F.size(spans) > 0, bound(ends, rows)).otherwise(none)

    both = F.struct(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)).alias("s"), F.split(text, pattern, -1).alias("g"))
    present = F.contains(text, F.lit(hint)) if hint == "@" else text.rlike(hint)
    return F.when(F.coalesce(present, F.lit(False)), bound(both, placed)).otherwise(none)


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """Whether the Luhn sum of a string of digits is a multiple of ten."""
    doubled = F.array(*[F.lit(2 * d // 10 + 2 * d % 10) for d in range(10)])
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, F.get(doubled, F.try_to_number(c, F.lit("9")).cast("int"))).otherwise(F.try_to_number(c, F.lit("9")).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _octets(span: Column) -> Column:
    bare = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    return F.forall(F.split(span, r"\."), lambda p: (F.length(bare(p)) < 3) | ((F.length(bare(p)) == 3) & (bare(p) <= "255")))


def _valid(kind: str, span: Column) -> Column:
    if kind == "ip":
        return _octets(span)
    if kind == "card":
        return F.length(_digits(span)).between(12, 19) & luhn(_digits(span))
    if kind == "phone":
        return F.length(_digits(span)).between(9, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, -1).when(yes, 1).otherwise(0)


def _votes(kind: str, x: Column) -> Column:
    """The labelers' votes on a candidate, in the order of LABELERS."""
    span, digits, no = x["span"], _digits(x["span"]), F.lit(False)
    known = span.rlike(rf"(?i)(?:\.|dot\W{{0,2}})(?:{TLDS})$")
    if kind == "email":
        check = _vote(span.rlike(r"[A-Za-z]"), ~span.rlike(r"[A-Za-z]") | span.rlike(r"\.\.|^[.-]"))
        gazetteer = _vote(known, ~known | span.rlike(PROSE))
    elif kind == "ip":
        check = F.when(span.contains("."), _vote(_octets(span), ~_octets(span))).otherwise(_vote((F.size(F.split(span, ":")) == 8) | span.contains("::"), F.size(F.split(span, ":")) < 5))
        gazetteer = _vote(span.rlike(r"^(?:10|127|172|192)\.|^(?:2[0-9A-Fa-f]{3}|fe80|FE80):"), span.rlike(r"^(?:0|255)\.|^0{1,4}:0{1,4}:0{1,4}:"))
    elif kind == "card":
        check = _vote(luhn(digits), ~luhn(digits))
        gazetteer = _vote(digits.rlike(ISSUERS), ~digits.rlike(ISSUERS))
    else:
        check = _vote(F.length(digits).between(9, 15), ~F.length(digits).between(7, 15))
        codes = F.when(span.rlike(r"^(?:\+|00)"), digits.rlike(CALLING)).otherwise(digits.rlike("^(?:0[1-9]|[2-9][0-9]{2}[2-9])"))
        gazetteer = _vote(codes, ~codes)
    form, not_form = FORMS[kind]
    inside = x["before"].rlike(r"[\p{L}\p{N}_=]$") | x["after"].rlike(r"^[\p{L}\p{N}_]|^[.,:/-][0-9]")
    votes = _vote(span.rlike(form), span.rlike(not_form)), check, gazetteer, _vote(x["before"].rlike(CUES[kind]), no), _vote(no, x["before"].rlike(AGAINST)), _vote(~inside, inside)
    return F.array(*votes)


def _features(kind: str, x: Column) -> Column:
    """What a span and its neighbourhood look like, in the order of FEATURES: 0 or 1 each."""
    span, digits = x["span"], _digits(x["span"])
    separators = F.regexp_replace(span, "[0-9A-Za-z]+", "")
    usual = {"email": F.length(span).between(8, 40), "ip": F.length(span).between(7, 39), "card": F.length(digits).between(15, 16), "phone": F.length(digits).between(10, 13)}[kind]
    few = F.length(F.regexp_replace(digits, r"([0-9])(?=[0-9]*\1)", "")) <= 2 if kind != "email" else F.lit(False)
    flags = (
        usual, F.length(F.regexp_replace(F.left(separators, F.lit(40)), r"(.)(?=.*\1)", "")) <= 1, F.length(separators).between(2, 4), x["before"].rlike(r"[:=]\x20?$"),
        digits.rlike("^0"), (F.length(digits) <= 40) & few, x["before"].rlike("[0-9][^0-9]{0,3}$"), x["before"].rlike(r"\p{Lu}\p{L}*\W{0,2}$"), separators == "",
    )
    return F.array(*[F.coalesce(f, F.lit(False)).cast("int") for f in flags])


def _apart(base: Column, loose: Column) -> Column:
    """base and those of loose that overlap none of base; each is looked up in base by binary search."""

    def free(b: Column) -> Column:
        rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(b["s"]) + 1.0)).cast("int"))

        def apart(x: Column) -> Column:
            half = lambda a: F.call_function("div", a["lo"] + a["hi"], F.lit(2)).cast("int")
            narrowed = lambda a, _: F.when(a["lo"] >= a["hi"], a).when(F.get(b["s"], half(a))["start"] < x["stop"], F.struct((half(a) + 1).alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), half(a).alias("hi")))
            before = F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), F.size(b["s"]).alias("hi")), narrowed, lambda a: a["lo"])
            return F.coalesce(F.get(b["m"], before - 1), F.lit(0)) <= x["start"]

        return F.concat(base, F.filter(loose, apart))

    def reached(s: Column) -> Column:
        return bound(F.struct(s.alias("s"), scan(F.transform(s, lambda y: y["stop"]), F.greatest).alias("m")), free)

    some = bound(F.array_sort(F.transform(base, lambda y: F.struct(y["start"].alias("start"), y["stop"].alias("stop")))), reached)
    return F.when(F.size(loose) == 0, base).when(F.size(base) == 0, loose).otherwise(some)


def candidates(text: Column) -> Column:
    """All base spans and all loose candidates that overlap none of them, by kind and start: array of _CANDIDATE."""

    def found(kind: str, base: bool) -> Column:
        got = _matches(text, (BASE if base else LOOSE)[kind], (_HINT if base else _LOOSE_HINT)[kind])
        if base and kind != "email":
            got = F.filter(got, lambda x: _valid(kind, x["span"]))
        k = KINDS.index(kind)
        as_candidate = lambda x: F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), F.lit(base).alias("base"), _votes(kind, x).alias("votes"), _features(kind, x).alias("features"))
        return F.transform(got, as_candidate).cast(f"array<{_CANDIDATE}>")

    base, loose = (F.concat(*[found(k, b) for k in KINDS]) for b in (True, False))
    return bound(F.struct(base.alias("b"), loose.alias("l")), lambda x: _apart(x["b"], x["l"]))


def ordered(spans: Column) -> Column:
    """Spans by start, then by kind as listed."""
    return F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop"), x["base"].alias("base"))))


def written(spans: Column) -> Column:
    """kind:start:end of ordered spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")


@dataclass(frozen=True)
class Model:
    """Weights of the span classifier by kind (a constant, one per vote, one per feature), and how the labelers vote: by kind,
    labeler, and whether the span is personal data, the shares of votes against, none and for."""

    weights: dict[int, tuple[float, ...]]
    labelers: dict[int, tuple]

    def score(self, x: Column) -> Column:
        """The log-odds that candidate x is personal data."""
        out = F.lit(-1.0)
        for k, w in self.weights.items():
            z = F.lit(w[0])
            for i, v in enumerate(w[1:]):
                z = z + F.lit(v) * (F.get(x["votes"], F.lit(i)) if i < len(LABELERS) else F.get(x["features"], F.lit(i - len(LABELERS))))
            out = F.when(x["kind"] == k, z).otherwise(out)
        return out

    def spans(self, found: Column) -> Column:
        """Base spans and the loose candidates that the classifier accepts, in order."""
        return ordered(F.filter(found, lambda x: x["base"] | (self.score(x) > 0)))


def reliabilities(patterns: Sequence[tuple[tuple[int, ...], int]], rounds: int = 60) -> tuple[float, np.ndarray, np.ndarray]:
    """Expectation-maximisation over (votes, count): the prior, each labeler's shares of votes (against, none, for) on other
    things and on personal data, and the posteriors of the patterns.

    Shares are smoothed by ten votes, of which most agree with the truth, and a vote never counts against what it says.
    """
    votes, n = np.array([v for v, _ in patterns]) + 1, np.array([c for _, c in patterns], float)
    m = votes.shape[1]
    smooth = np.array([[5.0, 4.0, 1.0], [1.0, 4.0, 5.0]])
    shares, prior = np.tile(smooth / 10, (m, 1, 1)), 0.5
    for _ in range(rounds):
        z = np.full(len(n), np.log(prior / (1 - prior)))
        for j in range(m):
            z += np.log(shares[j, 1, votes[:, j]] / shares[j, 0, votes[:, j]])
        post = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        prior = float(np.clip((5 + post @ n) / (10 + n.sum()), 0.05, 0.95))
        for j in range(m):
            got = np.stack([np.bincount(votes[:, j], n * p, minlength=3) for p in (1 - post, post)]) + smooth
            shares[j] = got / got.sum(axis=1, keepdims=True)
            for v, right in ((0, 0), (2, 1)):
                if shares[j, right, v] < shares[j, 1 - right, v]:
                    shares[j, :, v] = got[:, v].sum() / got.sum()
    return prior, shares, post


def logistic(x: np.ndarray, weight: np.ndarray, target: np.ndarray, penalty: float = 0.02, rounds: int = 60) -> tuple[float, ...]:
    """Weights (constant first) of a penalised logistic regression on rows x, fitted to soft targets by Newton's method."""
    a, share = np.c_[np.ones(len(x)), x], weight / weight.sum()
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (share * np.maximum(p * (1 - p), 1e-3))[:, None]).T @ a + penalty * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (share * (p - target)) + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def fit(found: DataFrame) -> Model:
    """A model from a column `found` of candidates; only counts by kind, votes and features, a bounded table, reach the driver.

    A pattern counts by the square root of its spans, so that the commonest kind of base span doesn't outweigh all others.
    """
    counts: dict[int, list] = {}
    rows = found.select(F.explode("found").alias("x")).groupBy("x.kind", "x.votes", "x.features").count().collect()
    for r in sorted(rows, key=lambda r: (r["kind"], r["votes"], r["features"])):
        counts.setdefault(r["kind"], []).append((tuple(r["votes"]), tuple(r["features"]), r["count"]))
    weights, labelers = {}, {}
    for k, patterns in counts.items():
        n = np.sqrt([c for *_, c in patterns])
        _, shares, post = reliabilities([(v, c) for (v, *_), c in zip(patterns, n, strict=True)])
        labelers[k] = tuple(map(tuple, shares.reshape(-1, 3).tolist()))
        weights[k] = logistic(np.array([(*v, *f) for v, f, _ in patterns], float), n, post)
    return Model(weights, labelers)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans: array<struct<start, kind, stop, base>>) for every row: base spans and those that the method adds.

    kind is an index into KINDS; positions are code points, the end exclusive. Null and empty texts have no spans; repeated
    rows and ids give a row each; other columns, whatever their names, are ignored; an empty table gives an empty result.
    Texts are read once and never shuffled.
    """
    found = materialize(docs.select(F.col(id_col), candidates(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("found")), "candidates")
    model = fit(found)
    return found.select(id_col, model.spans(F.col("found")).alias("spans"))


#: Code points of the pieces that a text is cut into, so that a place in a long text is reached without counting from its start.
_PIECE = 256


def _redacted(text: Column, spans: Column) -> Column:
    """text with each run of overlapping spans, in order, replaced by the mark of its first one."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def between(b: Column, start: Column, stop: Column | None) -> Column:
        first = F.call_function("div", start, F.lit(_PIECE)).cast("int")
        last = F.call_function("div", stop, F.lit(_PIECE)).cast("int") if stop is not None else F.size(b["p"])
        whole = F.array_join(F.slice(b["p"], first + 1, F.greatest(last - first + 1, F.lit(0))), "")
        return F.substring(whole, start - first * _PIECE + 1, stop - start if stop is not None else F.length(whole))

    def applied(b: Column) -> Column:
        heads = F.filter(F.transform(b["s"], lambda x, i: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), F.when(i > 0, F.get(b["m"], i - 1)).otherwise(0).alias("at"))), lambda h: h["start"] >= h["at"])
        parts = F.transform(heads, lambda h: F.concat(between(b, h["at"], h["start"]), F.get(names, h["kind"])))
        return F.concat(F.array_join(parts, ""), between(b, F.element_at(b["m"], -1), None))

    def reached(s: Column) -> Column:
        pieces = F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{_PIECE}}})"), F.lit(1))
        state = F.struct(s.alias("s"), scan(F.transform(s, lambda x: x["stop"]), F.greatest).alias("m"), pieces.alias("p"))
        return F.when(F.size(s) == 0, text).otherwise(bound(state, applied))

    return bound(spans, reached)


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with every span of personal data replaced by its kind in angle brackets; columns stay as they are.

    Overlapping spans become one mark, of the first. length_col, if present, becomes the new length. Null texts stay null;
    empty texts and repeated rows stay as they are; an empty table gives an empty one. Spans are found once: docs are written
    with them, and read again for the marks.
    """
    at = "found"
    while at in docs.columns:
        at = f"_{at}"
    text = F.col(text_col).cast("string")
    found = materialize(docs.withColumn(at, candidates(F.coalesce(text, F.lit("")))), "candidates")
    model = fit(found.select(F.col(at).alias("found")))
    out = found.withColumn(text_col, F.when(text.isNotNull(), _redacted(text, model.spans(F.col(at)))))
    if length_col and length_col in docs.columns:
        out = out.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.length(text_col)).cast(docs.schema[length_col].dataType))
    return out.select(*docs.columns)
