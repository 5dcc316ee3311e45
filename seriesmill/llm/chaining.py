"""Repeated passages by collinear chaining of shared k-mer seeds.

1. Seeds: minimizers of the hashes of k words, so that texts sharing k + w - 1 words in a row share a seed.
2. Matches: occurrences of a seed are sorted by document and place; each is joined with the first occurrence and with the one
   before it, so a seed in n documents gives at most 2n matches. What that leaves is tried after step 4, see below.
3. Chains: for each pair of documents, matches that rise in both are chained. A chain's score is the words its seeds cover
   less a cost for the words between them; the best predecessor of a match is a maximum over a prefix of places in the
   other document, kept in a Fenwick tree.
4. Alignment: the words of both sides are fetched, gaps between seeds aligned by edit distance and ends extended. What is
   long enough and alike enough is a passage; of a chain that isn't as a whole, so is each longest part that is.
5. The rest: passages put the documents of a seed into classes. If there are several, all pairs of documents of different classes
   are candidates, but those whose words around the seed rule a passage out; candidates go through 3 and 4 with all seeds that
   they share. Work on a seed grows with the square of its occurrences that are in different surroundings and not in one class.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, discard, materialize, python_workers, word_blocks

K, W = 8, 12
#: Cost of each word between two seeds of a chain, on either side, and the most words between them.
GAP_COST, MAX_GAP = 0.25, 60
#: Requests for words of one document that go together; a document that many chains ask for is asked in several lots.
ASKED = 500
#: Fetched around a chain on each side, to extend its ends into.
MARGIN = 64
#: Words looked at on each side of a seed to tell which documents it may give a passage: a run that isn't enough alone, then the
#: most that lie between it and what continues it.
SEEN = 50 + MAX_GAP
#: Chains aligned together, and bytes of texts that are hashed, or of words that are sent, together.
TOGETHER, BYTES = 8192, 1 << 22
#: Pairs of documents that are left and compared at once: so many, or so many for each document if that is more. What a lot of them
#: takes of disk follows the documents, whatever the pairs, as the shuffle files of one lot go before the next.
PAIRS = (1 << 16, 2)
#: Set while a table is written: Spark deletes the shuffle files when that ends, and narrow rows go to Python in large batches.
WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}
_P = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64
#: The primes of XXH64, and which bytes make words.
_X = [_U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]
_IN_WORD = ~np.isin(np.arange(256), list(SPACES.encode()))


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of text lower-cased in A-Z."""
    digest = xxhash.xxh64_intdigest
    parts = [np.fromiter(map(digest, block), np.uint64, len(block)) for block in word_blocks(data.lower())]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return (x << _U(n)) | (x >> _U(64 - n))


def hashes_of(texts: list[bytes]) -> list[np.ndarray]:
    """word_hashes of each text, for all at once: XXH64 of words up to 31 bytes by their length."""
    data = b" ".join(texts).lower() + b" " * 8
    raw = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(_IN_WORD[raw], prepend=False, append=False))
    start, size = edge[::2], edge[1::2] - edge[::2]
    out = np.zeros(len(start), np.uint64)
    order = np.argsort(np.minimum(size, 32).astype(np.uint8), kind="stable")
    ends = np.searchsorted(size[order], np.arange(1, 33))
    eight, four = (np.ndarray(len(data) - 7, t, data, strides=(1,)) for t in (np.uint64, np.uint32))
    for n, (lo, hi) in enumerate(zip(ends.tolist(), ends[1:].tolist(), strict=False), 1):
        if lo == hi:
            continue
        at = start[order[lo:hi]]
        x = np.full(hi - lo, _X[4] + _U(n))
        for _ in range(n // 8):
            x ^= _rotated(eight[at] * _X[1], 31) * _X[0]
            x = _rotated(x, 27) * _X[0] + _X[3]
            at = at + 8
        if n & 4:
            x ^= four[at] * _X[0]
            x = _rotated(x, 23) * _X[1] + _X[2]
            at = at + 4
        for j in range(n & 3):
            x ^= raw[at + j] * _X[4]
            x = _rotated(x, 11) * _X[0]
        x = (x ^ (x >> _U(33))) * _X[1]
        x = (x ^ (x >> _U(29))) * _X[2]
        out[order[lo:hi]] = x ^ (x >> _U(32))
    for i in order[ends[-1] :].tolist():
        out[i] = xxhash.xxh64_intdigest(data[start[i] : start[i] + size[i]])
    return np.split(out, np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts[:-1]]))) if texts else []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(29))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


def seeds(words: np.ndarray, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the minimizers: the least k-mer hash of each w in a row, the last of equal ones."""
    n = len(words) - k + 1
    if n < 1:
        return words[:0], np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * _P + words[j : j + n]
    h = _mix(h)
    if n <= w:
        at = np.array([n - 1 - int(np.argmin(h[::-1]))])
        return h[at], at
    windows = np.lib.stride_tricks.sliding_window_view(h[::-1], w)
    at = np.unique(n - 1 - (np.arange(n - w + 1) + windows.argmin(axis=1)))
    return h[at], at


def seeds_of(texts: list[np.ndarray], k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """seeds of each text, for all at once: number of the text, hashes and places."""
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size) - size
    words = np.concatenate([*texts, np.zeros(0, np.uint64)])
    n = max(0, len(words) - k + 1)
    h = np.zeros(n, np.uint64)
    for j in range(k if n else 0):
        h *= _P
        h += words[j : j + n]
    h = _mix(h)
    at, reach = np.arange(n), 1  # where the least of the reach hashes from each place on is, the last of equal ones
    while reach < w and len(at):
        on = min(reach, w - reach)
        left, right = at[: max(0, len(at) - on)], at[on:]
        at, reach = np.where(h[left] < h[right], left, right), reach + on
    windows = size - k + 1 - w + 1  # of each text
    inside = np.zeros(len(at) + 1, np.int64)  # 1 where windows of one text start, summed up below
    many = np.flatnonzero(windows > 0)
    np.add.at(inside, begin[many], 1)
    np.add.at(inside, begin[many] + windows[many], -1)
    at = at[np.cumsum(inside)[:-1] > 0]
    at = at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at
    few = np.flatnonzero((windows <= 0) & (size >= k))
    at = np.sort(np.r_[at, [x + size[i] - k - int(np.argmin(h[x : x + size[i] - k + 1][::-1])) for i, x in zip(few, begin[few], strict=True)]].astype(np.int64))
    text = np.searchsorted(begin + size, at, "right")
    return text, h[at], at - begin[text]


def _lots(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Parts of a batch with the word hashes of their texts."""
    texts = b.column(b.schema.get_field_index("text")).cast(pa.binary())
    held: list[bytes] = []
    n = 0
    for i, text in enumerate(texts, 1):
        held.append(text.as_py() or b"")
        n += len(held[-1])
        if i == b.num_rows or n >= BYTES:
            yield b.slice(i - len(held), len(held)), hashes_of(held) if n < 2 * BYTES else [word_hashes(t) for t in held]
            held, n = [], 0


def _seeded(k: int, w: int, sparse: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in (lot for whole in batches for lot in _lots(whole)):
            text, h, p = seeds_of(texts, k, w)
            if sparse:
                keep = _sparse(h, text)
                text, h, p = text[keep], h[keep], p[keep]
            if len(h):
                cols = h.view(np.int64), b.column(0).to_numpy()[text], p.astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["seed", "doc", "at"])

    return run


def _matched(batches: Iterator[pa.RecordBatch], named: bool = False) -> Iterator[pa.RecordBatch]:
    """Matches from a partition sorted by seed, doc, at: a, b (the greater and the smaller document), at_a, at_b.

    Only the first and the last occurrence of the seed at hand are kept between batches. If named, the seed comes first in each
    row, and further occurrences in the seed's first document, which no match has, are given as matches with itself.
    """
    names = ["a", "b", "at_a", "at_b"]
    head = prior = None  # (seed, doc, at): first of the seed; last seen in a document below the current one
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        s, d, p = (b.column(i).to_numpy() for i in range(3))
        if last is not None:  # the seed's first, the latest of another document and the last one stand in front
            front = [x for x in dict.fromkeys((head, prior, last)) if x is not None]
            s, d, p = (np.concatenate([[x[i] for x in front], c]).astype(c.dtype) for i, c in enumerate((s, d, p)))
            skip = len(front)
        else:
            skip = 0
        n = len(s)
        i = np.arange(n)
        new = np.r_[True, s[1:] != s[:-1]]
        first = np.maximum.accumulate(np.where(new, i, 0))
        block = np.maximum.accumulate(np.where(new | np.r_[True, d[1:] != d[:-1]], i, 0))  # where this document starts
        before = block - 1  # the last of the document before it
        use = (i >= skip) & (d != d[first])
        a, f, q = i[use], first[use], before[use]
        two = q > f
        x, y = np.r_[a, a[two]], np.r_[f, q[two]]
        if named:
            again = np.flatnonzero((i >= skip) & (d == d[first]) & (i != first))
            x, y = np.r_[x, again], np.r_[y, first[again]]
        if len(x):
            cols = [d[x], d[y], p[x], p[y]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in ([s[x], *cols] if named else cols)], ["seed", *names] if named else names)
        head = (s[-1], d[first[-1]], p[first[-1]])
        prior = (s[-1], d[before[-1]], p[before[-1]]) if block[-1] > first[-1] else None
        last = (s[-1], d[-1], p[-1])


def _covered(k: int):
    """For each seed and two documents that it was matched in, whether the passages found in the two cover all these matches.

    Rows, in order of a, b, kind: passages (kind 0) with their starts x, y and stops u, v; matches (kind 1) with places x, y.
    """

    def within(pair: np.ndarray, at: np.ndarray, owner: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        if not len(start):
            return np.zeros(len(at), bool)
        wide = np.int64(1) << 32
        order = np.argsort(owner * wide + start, kind="stable")
        starts, reach = (owner * wide + start)[order], np.maximum.accumulate((owner * wide + stop)[order])
        i = np.searchsorted(starts, pair * wide + at, "right") - 1
        return (i >= 0) & (reach[i] >= pair * wide + at + k)

    def of(t: np.ndarray) -> pa.RecordBatch | None:
        pair = np.cumsum(np.r_[True, (t[1:, :2] != t[:-1, :2]).any(axis=1)])
        p, m = t[:, 2] == 0, t[:, 2] == 1
        if not m.any():
            return None
        fine = within(pair[m], t[m, 4], pair[p], t[p, 4], t[p, 6]) & within(pair[m], t[m, 5], pair[p], t[p, 5], t[p, 7])
        order = np.lexsort((t[m, 3], pair[m]))
        own, fine = t[m][order], fine[order]
        first = np.flatnonzero(np.r_[True, (own[1:, [0, 1, 3]] != own[:-1, [0, 1, 3]]).any(axis=1)])
        return pa.RecordBatch.from_arrays([pa.array(own[first, 3]), pa.array(own[first, 0]), pa.array(own[first, 1]), pa.array(np.logical_and.reduceat(fine, first))], ["seed", "a", "b", "fine"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            if not b.num_rows:
                continue
            t = np.stack([c.to_numpy().astype(np.int64) for c in b.columns], axis=1)
            other = np.flatnonzero((t[:, 0] != t[-1, 0]) | (t[:, 1] != t[-1, 1]))
            stop = int(other[-1]) + 1 if len(other) else 0
            if stop or (held and (held[-1][-1, :2] != t[0, :2]).any()):
                if (found := of(np.concatenate([*held, t[:stop]]))) is not None:
                    yield found
                held = []
            held.append(t[stop:])
        if held and (found := of(np.concatenate(held))) is not None:
            yield found

    return run


def _root(parent: dict[int, int], i: int) -> int:
    while parent.setdefault(i, i) != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def classes(edges: list[tuple[int, int, bool]]) -> dict[int, int]:
    """Of a seed's documents, from its edges (a, b, fine), the class of each: the least document that fine edges lead to.

    A document is joined with others only if all its occurrences of the seed are covered: if it has a fine edge of its own, or
    is the first document and has no other occurrence (an edge with itself).
    """
    settled = {a for a, b, fine in edges if fine} | {min(b for _, b, _ in edges)} - {a for a, b, _ in edges if a == b}
    parent: dict[int, int] = {}
    for a, b, fine in edges:
        r, q = _root(parent, a), _root(parent, b)
        if fine and r != q and a in settled and b in settled:
            parent[max(r, q)] = min(r, q)
    return {d: _root(parent, d) for d in list(parent)}


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (seed, doc, class) of the seeds whose three or more documents are in several classes; rows by seed, a, b."""

    def of(s: np.ndarray, a: np.ndarray, b: np.ndarray, fine: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        size = np.diff(np.r_[start, len(s)])
        out: list[tuple[int, int, int]] = []
        for lo, n in zip(start.tolist(), size.tolist(), strict=True):
            if n < 2 or fine[lo : lo + n].all():
                continue
            found = classes(list(zip(a[lo : lo + n].tolist(), b[lo : lo + n].tolist(), fine[lo : lo + n].tolist(), strict=True)))
            if len(found) > 1 and len(set(found.values())) > 1:
                out.extend((int(s[lo]), d, c) for d, c in found.items())
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*out, strict=True) if out else ([], [], []))], ["seed", "doc", "class"])

    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        other = np.flatnonzero(t[0] != t[0][-1])
        stop = int(other[-1]) + 1 if len(other) else 0
        if stop or (held and held[-1][0][-1] != t[0][0]):
            yield of(*(np.concatenate(c) for c in zip(*held, [v[:stop] for v in t], strict=True)))
            held = []
        held.append([v[stop:] for v in t])
    if held:
        yield of(*(np.concatenate(c) for c in zip(*held, strict=True)))


def _sparse(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which of the texts' seeds to compare: of several equal ones in a row, as in text that repeats a phrase, the first and the
    last. What two such stretches share with their surroundings is aligned at one of their ends."""
    if not len(h):
        return np.zeros(0, bool)
    new = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return np.r_[True, new] | np.r_[new, True]


def _surroundings(k: int, w: int):
    """The words around each occurrence of the seeds asked for; rows: doc, text, asked (seed, class)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in (lot for whole in batches for lot in _lots(whole)):
            rows = []
            number, hs, ps = seeds_of(texts, k, w)
            keep = _sparse(hs, number)
            number, hs, ps = number[keep], hs[keep].view(np.int64), ps[keep]
            ends = np.searchsorted(number, np.arange(len(texts) + 1))
            for i, (doc, words, own) in enumerate(zip(b.column(0).to_pylist(), texts, b.column(2).to_pylist(), strict=True)):
                h, p = hs[ends[i] : ends[i + 1]], ps[ends[i] : ends[i + 1]]
                words = (words >> _U(32)).astype(np.uint32)
                wanted = {r["seed"]: r["class"] for r in own}
                for i in np.flatnonzero(np.isin(h, np.array(list(wanted), np.int64))).tolist():
                    at = int(p[i])
                    lo = max(0, at - SEEN)
                    rows.append((int(h[i]), doc, wanted[int(h[i])], at - lo, words[lo : at + k + SEEN].tobytes()))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["seed", "doc", "class", "at", "words"])

    return run


def _grams(views: np.ndarray) -> np.ndarray:
    """Hashes of three words in a row of each view and how often the view had them before, so that two views share as many
    hashes as three words in a row, each counted once. None that holds a cell beyond a text is alike another."""
    v = views.astype(np.uint64)
    g = np.sort(_mix((v[:, :-2] * _P + v[:, 1:-1]) * _P + v[:, 2:]), axis=1)
    i = np.broadcast_to(np.arange(g.shape[1]), g.shape)
    new = np.c_[np.ones(len(g), bool), g[:, 1:] != g[:, :-1]]
    return _mix(g + (i - np.maximum.accumulate(np.where(new, i, 0), axis=1)).astype(np.uint64) * _P)


def may_share(words: list[np.ndarray], at: list[int], group: np.ndarray, k: int = K, least: int = 50, identity: float = 0.8, cells: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of occurrences of one seed, of different groups, that may lie in one passage, from the words around them.

    An occurrence's run with another are the equal words around the seed. A passage longer than the run shares three words in a
    row outside it: ends are only extended past a differing word if three agree later, and the next seed of a chain has k. One
    of n words with e of them differing shares n - 2 - 3e times three words in a row; if it goes beyond the words looked at, the
    next seed is among them. Pairs that share less than that are out, unless the run alone is nearly enough.
    """
    whole = max(0, int(np.floor(least - 2 - 3 * (1 - identity) * least + 1e-9))) if identity > 2 / 3 else 0
    n, width = len(words), 2 * SEEN + k
    views = np.full((n, width), 0, np.int64)
    views += (np.int64(1) << 32) + np.arange(n)[:, None] * width + np.arange(width)  # cells beyond a text equal no other
    for i, (v, p) in enumerate(zip(words, at, strict=True)):
        views[i, SEEN - p : SEEN - p + len(v)] = v
    grams = _grams(views)
    value, inverse, count = np.unique(grams.ravel(), return_inverse=True, return_counts=True)
    inverse = inverse.reshape(grams.shape)
    common = np.flatnonzero(count > max(8, n // 8))
    number = np.full(len(value), -1)
    number[common] = np.arange(len(common))
    dense = np.zeros((n, len(common)), np.float32)
    r, c = np.nonzero(number[inverse] >= 0)
    np.add.at(dense, (r, number[inverse[r, c]]), 1)
    r, c = np.nonzero((count[inverse] > 1) & (number[inverse] < 0))
    g = inverse[r, c]
    order = np.lexsort((r, g))
    g, holder = g[order], r[order]  # of the rarer ones, who holds them
    stop = np.searchsorted(g, g, "right")
    step = max(1, cells // n)
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        shared = dense[lo:hi] @ dense.T
        mine = np.flatnonzero((holder >= lo) & (holder < hi))
        size = stop[mine] - mine - 1  # the holders after this one
        here = np.repeat(holder[mine], size)
        there = holder[np.repeat(mine + 1, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
        np.add.at(shared, (here - lo, there), 1)
        run = np.full((hi - lo, n), k, np.int32)
        for places in (range(SEEN + k, width), range(SEEN - 1, -1, -1)):
            alive = np.ones((hi - lo, n), bool)
            for x in places:
                alive &= views[lo:hi, x][:, None] == views[:, x]
                if not alive.any():
                    break
                run += alive
        fits = ((shared >= np.minimum(np.maximum(run - 1, whole), run + k - 4)) | (run >= least - 10)) & (group[lo:hi, None] != group) & (np.arange(lo, hi)[:, None] < np.arange(n))
        i, j = np.nonzero(fits)
        if len(i):
            yield i + lo, j


def _candidates(k: int, least: int, identity: float):
    """Pairs of documents (a, b) to compare, from the occurrences of the seeds whose documents are apart, in order of seed.

    Occurrences in equal surroundings are compared as one: each of their documents with the first of them, and that with others.
    """

    def of(rows: list[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        first: dict[tuple[int, bytes], int] = {}
        parent: dict[int, int] = {}
        out: set[tuple[int, int]] = set()
        for doc, group, at, words in rows:
            if len(words) < 4 * least:
                continue
            i = first.setdefault((at, words), doc)
            if i != doc:
                out.add((doc, i))
        docs, often = {doc: group for doc, group, _, _ in rows}, Counter(doc for doc, *_ in rows)
        for a, b in out:
            if often[a] == often[b] == 1:  # else another occurrence may have other partners
                r, q = _root(parent, docs[a]), _root(parent, docs[b])
                parent[max(r, q)] = min(r, q)
        out = {(a, b) for a, b in out if docs[a] != docs[b]}
        seen = list(first.items())
        if len(seen) > 1:
            doc = np.array([d for _, d in seen])
            group = np.array([_root(parent, docs[d]) for _, d in seen])
            if (group != group[0]).any():
                for i, j in may_share([np.frombuffer(w, np.uint32) for (_, w), _ in seen], [p for (p, _), _ in seen], group, k, least, identity):
                    pairs = np.unique(np.stack([np.maximum(doc[i], doc[j]), np.minimum(doc[i], doc[j])]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in pairs], ["a", "b"])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([max(p) for p in out]), pa.array([min(p) for p in out])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for seed, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if seed != now and held:
                    yield from of(held)
                    held = []
                now = seed
                held.append(tuple(row))
        if held:
            yield from of(held)

    return run


class Fenwick:
    """Maxima over prefixes of places 0 to n - 1, each with the index of the item that attains it."""

    def __init__(self, n: int):
        self.n, self.best, self.item = n, [-np.inf] * (n + 1), [-1] * (n + 1)

    def add(self, place: int, value: float, item: int) -> None:
        i = place + 1
        while i <= self.n:
            if value > self.best[i]:
                self.best[i], self.item[i] = value, item
            i += i & -i

    def before(self, place: int) -> tuple[float, int]:
        """The maximum over places below this one."""
        value, item = -np.inf, -1
        i = place
        while i > 0:
            if self.best[i] > value:
                value, item = self.best[i], self.item[i]
            i -= i & -i
        return value, item


def chains(x: np.ndarray, y: np.ndarray, k: int = K, cost: float = GAP_COST, max_gap: int = MAX_GAP) -> list[list[int]]:
    """Chains of matches (x, y), sorted by x, that rise in both, the best first; each match is in one chain at most.

    With a cost for each word between seeds, on either side, score(i) = k + max(0, max over j before i of score(j) + cost *
    (x_j + y_j)) - cost * (x_i + y_i) + 2k cost), which is a prefix maximum. Chains part where a gap exceeds max_gap.
    """
    n = len(x)
    xs, ys = x.tolist(), y.tolist()
    ranks = np.unique(y, return_inverse=True)[1].tolist()
    tree, score, back = Fenwick(max(ranks, default=0) + 1), [0.0] * n, [-1] * n
    i = 0
    while i < n:
        j = i
        while j < n and xs[j] == xs[i]:  # of one place in x only one can be in a chain
            value, item = tree.before(ranks[j])
            gain = 0.0
            if item >= 0:
                dx, dy = xs[j] - xs[item], ys[j] - ys[item]
                fresh = min(k, dx, dy)
                gain = score[item] - cost * (max(0, dx - k) + max(0, dy - k)) + fresh - k
                if dx > max_gap or dy > max_gap:
                    gain = 0.0
            score[j], back[j] = (k + gain, item) if gain > 0 else (float(k), -1)
            j += 1
        for m in range(i, j):
            tree.add(ranks[m], score[m] + cost * (xs[m] + ys[m]), m)
        i = j
    out, used = [], [False] * n
    for i in sorted(range(n), key=lambda i: (-score[i], i)):
        if used[i]:
            continue
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = back[i]
        out.append(chain[::-1])
    return out


def _merged(x: np.ndarray, y: np.ndarray, new: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Seeds of chains as runs of equal words: where they start in both documents, their lengths, and which seed starts each.

    new marks the seeds that start a chain. Seeds on one diagonal that overlap or touch make one run.
    """
    dx, dy = np.diff(x, prepend=0), np.diff(y, prepend=0)
    first = np.flatnonzero(new | (dx != dy) | (dx > k))
    last = np.r_[first[1:], len(x)] - 1
    return x[first], y[first], x[last] - x[first] + k, first


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[starts, len(values)].astype(np.int32)), pa.array(values.astype(np.int32)))


def _chains_of(t: np.ndarray, k: int, least: int) -> pa.RecordBatch | None:
    """The chains of whole pairs of documents, from rows a, b, at_a, at_b in order: a, b, and the runs of equal words.

    Where each seed of a pair gains by following the one before it on its diagonal, that is the chain, and no other can score
    more; such pairs, most of them, are taken together. The others go through the recurrence.
    """
    fresh = np.r_[True, (t[1:] != t[:-1]).any(axis=1)]
    t = t[fresh]
    pair = np.r_[True, (t[1:, :2] != t[:-1, :2]).any(axis=1)]
    dx, dy = np.diff(t[:, 2], prepend=0), np.diff(t[:, 3], prepend=0)
    gain = np.minimum(k, dx) - 2 * GAP_COST * np.maximum(0, dx - k)
    follows = (dx == dy) & (dx > 0) & (dx <= MAX_GAP) & (gain > 0)
    start = np.flatnonzero(pair)
    size = np.diff(np.r_[start, len(t)])
    plain = np.logical_and.reduceat(follows | pair, start)
    order = np.flatnonzero(np.repeat(plain, size))
    new = pair[order]
    rest: list[np.ndarray] = []
    lengths: list[int] = []
    for lo, n in zip(start[~plain].tolist(), size[~plain].tolist(), strict=True):
        found = chains(t[lo : lo + n, 2], t[lo : lo + n, 3], k)
        rest.append(np.array([i for c in found for i in c]) + lo)
        lengths.extend(map(len, found))
    if rest:
        heads = np.zeros(sum(lengths), bool)
        heads[np.cumsum([0, *lengths[:-1]])] = True
        order, new = np.concatenate([order, *rest]), np.r_[new, heads]
    rows = t[order]
    xs, ys, ns, first = _merged(rows[:, 2], rows[:, 3], new, k)
    heads = np.flatnonzero(new[first])  # of the runs, those that start a chain
    tails = np.r_[heads[1:], len(xs)] - 1
    long = np.minimum(xs[tails] - xs[heads], ys[tails] - ys[heads]) + ns[tails] + 2 * MARGIN >= least
    if not long.any():
        return None
    keep = np.repeat(long, tails - heads + 1)
    begin = np.cumsum(np.r_[0, (tails - heads + 1)[long]])[:-1]
    ids = rows[first[heads[long]], :2]
    return pa.RecordBatch.from_arrays([pa.array(ids[:, 0]), pa.array(ids[:, 1]), *(_lists(v[keep], begin) for v in (xs, ys, ns))], ["a", "b", "xs", "ys", "ns"])


def _chained(k: int, least: int):
    """Chains of a partition sorted by a, b, at_a, at_b that can reach least words, as runs of equal words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            if not b.num_rows:
                continue
            t = np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(4)], axis=1)
            same = np.flatnonzero((t[:, 0] != t[-1, 0]) | (t[:, 1] != t[-1, 1]))
            stop = int(same[-1]) + 1 if len(same) else 0
            if stop or (held and (held[-1][-1, :2] != t[0, :2]).any()):
                if (found := _chains_of(np.concatenate([*held, t[:stop]]), k, least)) is not None:
                    yield found
                held = []
            held.append(t[stop:])
        if held and (found := _chains_of(np.concatenate(held), k, least)) is not None:
            yield found

    return run


def edit_distance(a: np.ndarray, b: np.ndarray) -> int:
    """Levenshtein distance of two short arrays, a column of the matrix at a time as bits (Myers, Hyyrö)."""
    if not len(a) or not len(b):
        return max(len(a), len(b))
    places: dict[int, int] = {}
    for i, c in enumerate(a.tolist()):
        places[c] = places.get(c, 0) | 1 << i
    full, high, distance = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = full, 0  # where a column rises and falls by one
    for c in b.tolist():
        same = places.get(c, 0)
        across = (((same & up) + up) ^ up) | same
        more, less = down | (full & ~(across | up)), up & across
        distance += bool(more & high) - bool(less & high)
        more, less = (more << 1 | 1) & full, less << 1 & full
        up, down = less | (full & ~(same | down | more)), more & (same | down)
    return distance


def extend(a: np.ndarray, b: np.ndarray, drop: int = 6) -> tuple[int, int, int]:
    """How far two arrays stay alike from their starts: lengths and differing words; ends where the score falls by drop.

    A differing word may be a replacement, or a word more on one side if the words after it then agree.
    """
    n = min(len(a), len(b))
    unlike = a[:n] != b[:n]
    same = int(unlike.argmax()) if n else 0
    if n and not unlike[same]:
        return n, n, 0
    a, b = a[same:].tolist(), b[same:].tolist()
    i = j = errors = 0
    score = same
    best = (same, 0, 0, 0)
    while i < len(a) and j < len(b) and score > best[0] - drop:
        if a[i] == b[j]:
            i, j, score = i + 1, j + 1, score + 1
            if score > best[0]:
                best = (score, i, j, errors)
            continue
        if i + 2 < len(a) and j + 1 < len(b) and a[i + 1] == b[j] and a[i + 2] == b[j + 1]:
            i += 1
        elif j + 2 < len(b) and i + 1 < len(a) and b[j + 1] == a[i] and b[j + 2] == a[i + 1]:
            j += 1
        else:
            i, j = i + 1, j + 1
        score, errors = score - 2, errors + 1
    return same + best[1], same + best[2], best[3]


def extend_all(a: np.ndarray, b: np.ndarray, drop: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """extend for each row of a and b, which beyond the ends of their arrays hold -1 and -2, in the last three columns at least."""
    rows, width = a.shape
    a, b = a.ravel(), b.ravel()
    base = np.arange(rows) * width
    best = np.zeros((4, rows), np.int64)  # score, lengths, differing words
    at, i, j, score, errors = (np.arange(rows), *np.zeros((4, rows), np.int64))
    while len(at):
        x, y = a[base[at] + i], b[base[at] + j]
        live = (x != -1) & (y != -2) & (score > best[0, at] - drop)
        if not live.all():
            at, i, j, score, errors, x, y = (v[live] for v in (at, i, j, score, errors, x, y))
        same = x == y
        u = np.flatnonzero(~same)
        p, q, x, y = base[at[u]] + i[u], base[at[u]] + j[u], x[u], y[u]
        more_a = (a[p + 1] == y) & (a[p + 2] == b[q + 1])
        more_b = ~more_a & (b[q + 1] == x) & (b[q + 2] == a[p + 1])
        i, j, score = i + 1, j + 1, score + 1
        i[u[more_b]] -= 1
        j[u[more_a]] -= 1
        score[u] -= 3
        errors[u] += 1
        new = np.flatnonzero(same & (score > best[0, at]))
        best[:, at[new]] = score[new], i[new], j[new], errors[new]
    return best[1], best[2], best[3]


def _extended(a: np.ndarray, b: np.ndarray, blocks: list[list[int]], errors: list[int]) -> tuple[int, int, int, int, int]:
    x, _, y, _ = blocks[0]
    left = extend(a[:x][::-1], b[:y][::-1])
    right = extend(a[blocks[-1][1] :], b[blocks[-1][3] :])
    return x - left[0], blocks[-1][1] + right[0], y - left[1], blocks[-1][3] + right[1], sum(errors) + left[2] + right[2]


def _blocks(a: np.ndarray, b: np.ndarray, xs: np.ndarray, ys: np.ndarray, ns: np.ndarray) -> tuple[list[list[int]], list[int]]:
    """Start and stop in a and in b of each part of a chain without differing words, and the differing words between them."""
    ax, by = int(xs[0]), int(ys[0])
    blocks, errors = [[ax, ax, by, by]], []
    for x, y, n in zip(xs.tolist(), ys.tolist(), ns.tolist(), strict=True):
        if x > ax or y > by:
            u, v = a[ax : max(ax, x)], b[by : max(by, y)]
            e = 0 if len(u) == len(v) and (u == v).all() else edit_distance(u, v)
            if e:
                errors.append(e)
                blocks.append([max(ax, x), 0, max(by, y), 0])
        ax, by = max(ax, x + n), max(by, y + n)
        blocks[-1][1::2] = ax, by
    return blocks, errors


def passages(a: np.ndarray, b: np.ndarray, xs: np.ndarray, ys: np.ndarray, ns: np.ndarray | int, least: int, identity: float) -> list[tuple[int, int, int, int, int]]:
    """What is long and alike enough of a chain, as start and stop in a and in b and the differing words: the whole, or else all
    parts from one of its blocks to another that are and that lie in no other such part. Parts are extended by MARGIN words at
    most, and may overlap. xs, ys, ns: where the chain's runs of equal words start in a and in b, and their lengths."""

    def alike(s, e, t, f, errors):
        return (np.minimum(e - s, f - t) >= least) & (1 - errors / np.maximum(np.maximum(e - s, f - t), 1) >= identity)

    blocks, errors = _blocks(a, b, xs, ys, np.broadcast_to(ns, len(xs)))
    whole = _extended(a, b, blocks, errors)
    if alike(*whole):
        return [whole]
    if len(blocks) == 1:
        return []
    before = lambda v, i: v[max(0, i - MARGIN) : i][::-1]
    left = np.array([extend(before(a, p[0]), before(b, p[2])) for p in blocks])
    right = np.array([extend(a[p[1] : p[1] + MARGIN], b[p[3] : p[3] + MARGIN]) for p in blocks])
    at = np.array(blocks)
    s, e, t, f = at[:, 0] - left[:, 0], at[:, 1] + right[:, 0], at[:, 2] - left[:, 1], at[:, 3] + right[:, 1]
    total = np.r_[0, np.cumsum(errors)]
    found: list[tuple[int, int, int, int, int]] = []
    for i in range(len(at)):
        errs = left[i, 2] + total[i:] - total[i] + right[i:, 2]
        if len(good := np.flatnonzero(alike(s[i], e[i:], t[i], f[i:], errs))):
            j = i + int(good[-1])
            found.append((int(s[i]), int(e[j]), int(t[i]), int(f[j]), int(errs[j - i])))
    out: list[tuple[int, int, int, int, int]] = []
    for r in sorted(set(found), key=lambda r: (r[0] - r[1], r[2] - r[3], r[4], r)):
        if not any(o[0] <= r[0] and r[1] <= o[1] and o[2] <= r[2] and r[3] <= o[3] for o in out):
            out.append(r)
    return sorted(out)


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The word hashes that a document's requests (chain, side, first, last) ask for; rows: text, requests. A batch ends with the
    row that fills it: requests ask for many times the words of a text."""
    names = ["chain", "side", "first", "last"]
    for b, texts in (lot for whole in batches for lot in _lots(whole)):
        asked = b.column(1)
        ends = asked.offsets.to_numpy()
        fields = dict(zip(names, (c.to_numpy() for c in (asked.values.field(n) for n in names)), strict=True))
        parts, at, size, start = [], np.maximum(fields["first"], 0), 0, int(ends[0])
        for i, text in enumerate(texts, 1):
            words = (text >> _U(32)).astype(np.uint32)
            for lo, hi in zip(at[ends[i - 1] : ends[i]].tolist(), fields["last"][ends[i - 1] : ends[i]].tolist(), strict=True):
                parts.append(words[lo:hi].tobytes())
                size += len(parts[-1])
            if parts and (size >= BYTES or i == len(texts)):
                own = slice(start, int(ends[i]))
                yield pa.RecordBatch.from_arrays([pa.array(fields["chain"][own]), pa.array(fields["side"][own]), pa.array(at[own]), pa.array(parts, pa.binary())], ["chain", "side", "lo", "words"])
                parts, size, start = [], 0, int(ends[i])


def _around(words: pa.Array, start: np.ndarray, stop: np.ndarray, fill: int) -> np.ndarray:
    """For extend_all, of each row's words those before start, backwards, then of each row those from stop on."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64) // 4
    flat = np.frombuffer(words.buffers()[2], np.uint32, int(ends[-1])) if ends[-1] else np.zeros(1, np.uint32)
    first, last = ends[:-1, None], ends[1:, None]
    step = np.arange(MARGIN + 3)
    at = np.concatenate([np.minimum(first + start[:, None], last) - 1 - step, first + stop[:, None] + step])
    within = (at >= np.r_[first, first]) & (at < np.r_[last, last]) & (step < MARGIN)
    return np.where(within, flat[np.where(within, at, 0)], np.int64(fill))


def _aligned(least: int, identity: float):
    names = ["doc_id", "start", "stop", "other_id", "other_start", "other_stop", "n_errors", "identity"]

    def several(t: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = []
        for a, b, xs, ys, ns, lo_a, wa, lo_b, wb in zip(*(c.to_pylist() for c in t.columns), strict=True):
            left, right = np.frombuffer(wa, np.uint32), np.frombuffer(wb, np.uint32)
            for s, e, t, f, errors in passages(left, right, np.array(xs) - lo_a, np.array(ys) - lo_b, np.array(ns), least, identity):
                rows.append((a, s + lo_a, e + lo_a, b, t + lo_b, f + lo_b, errors, 1 - errors / max(e - s, f - t)))
        kinds = [pa.int64()] * 7 + [pa.float64()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def single(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """Chains of one run, which have one block: what passages gives for each, for all at once."""
        a, b, lo_a, lo_b = (t.column(i).to_numpy().astype(np.int64) for i in (0, 1, 5, 7))
        xs, ys, n = (t.column(i).combine_chunks().flatten().to_numpy().astype(np.int64) for i in (2, 3, 4))
        sides = [_around(t.column(i).combine_chunks(), x, x + n, fill) for i, x, fill in ((6, xs - lo_a, -1), (8, ys - lo_b, -2))]
        u, v, errors = extend_all(*sides)
        left, right = slice(None, len(n)), slice(len(n), None)
        s, e, t, f = xs - u[left], xs + n + u[right], ys - v[left], ys + n + v[right]
        errors = errors[left] + errors[right]
        alike = 1 - errors / np.maximum(e - s, f - t)
        good = (np.minimum(e - s, f - t) >= least) & (alike >= identity)
        if good.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[good]) for c in (a, s, e, b, t, f, errors, alike)], names)

    def of(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        one = pc.equal(pc.list_value_length(t.column(2)), 1)
        for part, found in ((t.filter(one), single), (t.filter(pc.invert(one)), several)):
            if part.num_rows:
                yield from found(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= TOGETHER:
                yield from of(held)
                held = []
        if held:
            yield from of(held)

    return run


def _side(chained: DataFrame, doc: str, at: str, side: int) -> DataFrame:
    """The words that a side of each chain needs: those from a margin before its first seed to a margin after its last."""
    first, last = F.get(at, F.lit(0)) - MARGIN, F.element_at(at, -1) + F.element_at("ns", -1) + MARGIN
    return chained.select(F.col(doc).alias("doc"), F.struct("chain", F.lit(side).alias("side"), first.cast("int").alias("first"), last.cast("int").alias("last")).alias("r"))


def repeated_passages(docs: DataFrame, least: int = 50, identity: float = 0.8, k: int = K, w: int = W, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages of least words or more that two documents share but for differences: (doc_id, start, stop, other_id, other_start,
    other_stop, n_errors, identity), in words (`[^\\x20\\x09-\\x0D]+`, lower-cased in A-Z), other_id < doc_id.

    Each occurrence of a seed is compared with the first document that holds it and with the document before it; if passages
    over the seed don't connect all its documents, those that they leave apart are compared with each other. So two documents
    that share a passage are in a row, or its seeds lie in both in passages whose rows connect the two. No row is given twice. Passages
    that repeat within one document only are left out. Null ids and null or short texts have none; rows that repeat an id are
    one document with several texts and aren't compared with each other; other columns are ignored; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    python_workers(spark)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    found = own.mapInArrow(_seeded(k, w), "seed long, doc long, at int")
    named = found.repartition("seed").sortWithinPartitions("seed", "doc", "at").mapInArrow(lambda b: _matched(b, True), "seed long, a long, b long, at_a int, at_b int")
    matches = _written(named, "matches")
    passages_ = _written(_verified(own, matches.where("a <> b"), least, identity, k), "passages")
    pairs = _written(_untried(own, matches, passages_, least, identity, k, w), "pairs")
    discard(matches)
    lots = -(-pairs.count() // max(PAIRS[0], PAIRS[1] * own.count())) or 1
    for i in range(lots):
        lot = pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(lots)) == i)
        passages_ = passages_.union(_written(_verified(own, _between(own, lot, k, w), least, identity, k), "more"))
    return passages_.distinct()  # several chains of a pair may extend to one passage


def _written(df: DataFrame, name: str) -> DataFrame:
    """df materialised, with its batches bounded by their bytes; shuffle files of what led to it go as soon as it is written,
    whatever still refers to them."""
    conf = df.sparkSession.conf
    before = {key: conf.get(key, None) for key in WRITING}
    try:
        for key, value in WRITING.items():
            conf.set(key, value)
        return materialize(df, name)
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)


def _untried(own: DataFrame, matches: DataFrame, passages_: DataFrame, least: int, identity: float, k: int, w: int) -> DataFrame:
    """Pairs of documents (a, b) that a seed leaves in different classes and that may share a passage around it."""
    # the two kinds of rows by pair of documents; a seed's documents in classes; those of several classes by their surroundings
    spans = passages_.selectExpr("doc_id a", "other_id b", "0 kind", "0L seed", "start x", "other_start y", "stop u", "other_stop v")
    places = matches.selectExpr("a", "b", "1 kind", "seed", "cast(at_a as long) x", "cast(at_b as long) y", "0L u", "0L v")
    edges = spans.union(places).repartition("a", "b").sortWithinPartitions("a", "b", "kind").mapInArrow(_covered(k), "seed long, a long, b long, fine boolean")
    apart = edges.repartition("seed").sortWithinPartitions("seed", "a", "b").mapInArrow(_apart, "seed long, doc long, class long")
    asked = apart.groupBy("doc").agg(F.collect_list(F.struct("seed", "class")).alias("asked"))
    around = own.join(asked, own["id"] == asked["doc"]).select("doc", "text", "asked").mapInArrow(_surroundings(k, w), "seed long, doc long, class long, at int, words binary")
    order = around.repartition("seed").sortWithinPartitions("seed", "doc", "at").select("seed", "doc", "class", "at", "words")
    return order.mapInArrow(_candidates(k, least, identity), "a long, b long").distinct()


def _between(own: DataFrame, pairs: DataFrame, k: int, w: int) -> DataFrame:
    """All matches of the pairs of documents."""
    ids = pairs.selectExpr("explode(array(a, b)) id").distinct()
    found = own.join(ids, "id", "left_semi").mapInArrow(_seeded(k, w, sparse=True), "seed long, doc long, at int")
    left = found.selectExpr("seed", "doc a", "at at_a").join(pairs, "a")
    return left.join(found.selectExpr("seed", "doc b", "at at_b"), ["b", "seed"]).select("a", "b", "at_a", "at_b")


def _verified(own: DataFrame, matches: DataFrame, least: int, identity: float, k: int) -> DataFrame:
    """The passages that chains of matches (a, b, at_a, at_b) give."""
    chained = matches.select("a", "b", "at_a", "at_b").repartition("a", "b").sortWithinPartitions("a", "b", "at_a", "at_b").mapInArrow(_chained(k, least), "a long, b long, xs array<int>, ys array<int>, ns array<int>")
    chained = _written(chained.withColumn("chain", F.monotonically_increasing_id()), "chains")
    asked = _side(chained, "a", "xs", 0).union(_side(chained, "b", "ys", 1))
    often = asked.groupBy("doc").count().select(F.col("doc").alias("d"), F.ceil(F.col("count") / ASKED).alias("lots"))
    lots = asked.join(often, asked["doc"] == often["d"]).groupBy("doc", F.pmod(F.xxhash64("r.chain", "r.side"), F.col("lots")).alias("lot")).agg(F.collect_list("r").alias("asked"))
    words = own.join(lots, own["id"] == lots["doc"]).select("text", "asked").mapInArrow(_fetched, "chain long, side int, lo int, words binary")
    own_side = lambda n: F.max(F.when(F.col("side") == n, F.struct("lo", "words")))
    both = words.groupBy("chain").agg(own_side(0).alias("l"), own_side(1).alias("r"))
    joined = chained.join(both, "chain").select("a", "b", "xs", "ys", "ns", F.col("l.lo").alias("lo_a"), F.col("l.words").alias("wa"), F.col("r.lo").alias("lo_b"), F.col("r.words").alias("wb"))
    return joined.mapInArrow(_aligned(least, identity), "doc_id long, start long, stop long, other_id long, other_start long, other_stop long, n_errors long, identity double")
