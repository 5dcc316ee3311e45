"""SimHash near-duplicates: Golay-coded fuzzy keys, joined within buckets and verified by Hamming distance.

A fingerprint is one or more 64-bit words; a bit is 1 if it is set in over half the hashes of the document's word shingles.
Each table of a scheme takes some bits of the fingerprint exactly and a segment of up to 23 bits through the Golay code
(golay.py), whose one or six nearby codeword indices each give a key. Buckets of equal keys are verified bit by bit.

Two schemes:

* `exact_scheme()`: 64 bits, links at 3 or fewer differing bits, no link lost. Of four 16-bit blocks at least one has no
  error; whichever of the patterns (0,0,0,3), (0,0,1,2), (0,1,1,1) holds, some errorless block is followed, cyclically, by
  one with at most one error, which the Golay keys forgive. So four tables, each with a block exact and the next one fuzzy.
* `similarity_scheme(s)`: links documents whose shingle sets are alike by s (Jaccard) or more. That many differing bits
  can't be met by pigeonholes, so each of many independent tables forgives two errors in 23 bits, and 256 bits are compared:
  pairs that may be alike by them connect documents into groups, and within groups the shingle sets themselves decide. Groups
  whose sets fit one block are settled there, pair by pair; greater ones in pairs of blocks, but for the pairs of blocks that
  links already verified connect. Every link is verified, and no pair within a group is left out, whatever its size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import golay
from .common import materialize, python_workers, word_blocks
from .components import components

#: Runs up to this long are compared pair by pair at once; in longer ones a spanning set of links is found, which connects the same.
SHORT_RUN = 8
#: Shingles of a block, of which two meet in a task.
BLOCK = 1 << 20
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


@dataclass(frozen=True)
class Table:
    """Bits of one word of the fingerprint: a segment for the Golay code and bits taken exactly."""

    word: int
    fuzzy_at: int
    fuzzy_bits: int
    exact_at: int
    exact_bits: int


@dataclass(frozen=True)
class Scheme:
    words: int  # 64-bit words of a fingerprint
    compared: int  # of which so many are compared
    limit: int  # differing bits allowed in those
    tables: tuple[Table, ...]
    similarity: float | None = None  # of shingle sets, by which links are verified; then limit only says what may be alike


def exact_scheme() -> Scheme:
    return Scheme(1, 1, 3, tuple(Table(0, 16 * ((c + 1) % 4), 16, 16 * c, 16) for c in range(4)))


def similarity_scheme(similarity: float = 0.8, tables: int = 24) -> Scheme:
    """Sets of like size with Jaccard similarity s have cosine 2s/(1+s), and so differ in angle/pi of all bits."""
    words, compared = max(4, (tables + 1) // 2), 4
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = 64 * compared
    spread = math.sqrt(bits * share * (1 - share))
    own = tuple(Table(t // 2, 32 * (t % 2), 23, 32 * (t % 2) + 23, 9) for t in range(tables))
    return Scheme(words, compared, int(bits * share + 2.5 * spread), own, similarity)


def _mixed(h: np.ndarray, j: int) -> np.ndarray:
    """An independent 64-bit hash for each j > 0, from one hash."""
    if not j:
        return h
    x = h + np.uint64((j * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(data: bytes, k: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the k-word shingles of text that is lower-cased in A-Z, repeats included, in blocks."""
    rest: list[bytes] = []
    none = True
    digest = xxhash.xxh64_intdigest
    for block in word_blocks(data.lower()):
        words = rest + block
        n = len(words) - k + 1
        if n > 0:
            none = False
            joined = b" ".join(words)
            ends = list(accumulate((len(w) + 1 for w in words), initial=0))
            yield np.fromiter((digest(joined[a : b - 1], 42) for a, b in zip(ends[:n], ends[k:], strict=True)), np.uint64, n)
        rest = words[max(0, n) :]
    if none and rest:
        yield np.array([digest(b" ".join(rest), 42)], np.uint64)


def shingle_set(data: bytes | None, k: int) -> np.ndarray:
    """The hashes of the different shingles, sorted."""
    return np.unique(np.concatenate([*shingle_hashes(data or b"", k), np.zeros(0, np.uint64)]))


def fingerprint(data: bytes | None, k: int, words: int = 1, repeats: bool = True) -> bytes:
    """The words of the fingerprint, each as 8 bytes, highest bit first; zeros for a text without words or a null text.

    Without repeats each different shingle counts once, as in the similarity of sets.
    """
    ones, n = np.zeros((words, 64), np.int64), 0
    for h in shingle_hashes(data or b"", k) if repeats else [shingle_set(data, k)]:
        n += len(h)
        for j in range(words):
            b = _mixed(h, j).view(np.uint8).reshape(-1, 8)
            for i in range(8):
                ones[j, 8 * i : 8 * i + 8] += np.bincount(b[:, i], minlength=256) @ _BITS
    return np.packbits(2 * ones[:, ::-1] > n, axis=1).tobytes()


def _sketched(k: int, words: int, repeats: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            fp = [fingerprint(t.as_py(), k, words, repeats) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fp, pa.binary())], ["id", "fp"])

    return run


def _keyed(scheme: Scheme):
    """A row per table and key: key, rep and the compared part of the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rep = b.column(0).to_numpy()
            raw = np.frombuffer(b"".join(b.column(1).to_pylist()), ">u8").reshape(-1, scheme.words).astype(np.uint64)
            fp = b.column(1).to_pylist()
            for t, tab in enumerate(scheme.tables):
                w = raw[:, tab.word]
                index, used = golay.keys(w >> np.uint64(tab.fuzzy_at) & np.uint64((1 << tab.fuzzy_bits) - 1))
                exact = (w >> np.uint64(tab.exact_at) & np.uint64((1 << tab.exact_bits) - 1)).astype(np.int64)
                key = (np.int64(t) << 40) | (exact[:, None] << 12) | index.astype(np.int64)
                row, _ = np.nonzero(used)
                part = pa.array([fp[i][: 8 * scheme.compared] for i in row], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(key[used]), pa.array(rep[row]), part], ["key", "rep", "fp"])

    return run


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def spanning(fp: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Links (i, j) within limit that connect all that any such links connect, fewer than len(fp) of them.

    Pivots are compared with everything; what a pivot reaches is its ball. Two balls that are still apart can only touch
    if their pivots are within three limits, and only then are their members compared.
    """
    n = len(fp)
    label, ball, links, pivots = np.arange(n), np.full(n, -1), [], []
    rest = np.arange(n)
    while len(rest):
        p = rest[0]
        near = np.flatnonzero(_distance(fp[p], fp) <= limit)
        own, at = np.unique(label[near], return_index=True)
        links += [(int(p), int(near[i])) for c, i in zip(own, at, strict=True) if c != label[p]]
        label[np.isin(label, own)] = own[0]
        ball[near[ball[near] < 0]] = len(pivots)
        pivots.append(p)
        rest = rest[ball[rest] < 0]
    heads = np.array(pivots)
    members: dict[int, np.ndarray] = {}
    for i, p in enumerate(heads[:-1]):
        later = heads[i + 1 :]
        for j in np.flatnonzero((_distance(fp[p], fp[later]) <= 3 * limit) & (label[later] != label[p])) + i + 1:
            if label[heads[j]] == label[p]:
                continue
            a, b = (members.setdefault(x, np.flatnonzero(ball == x)) for x in (i, int(j)))
            for x in a:
                hit = b[_distance(fp[x], fp[b]) <= limit]
                if len(hit):
                    links.append((int(x), int(hit[0])))
                    label[label == label[heads[j]]] = label[p]
                    break
    return links


def _run_links(key: np.ndarray, rep: np.ndarray, fp: np.ndarray, scheme: Scheme) -> list[np.ndarray]:
    """Links (rep, rep) within runs of equal keys that connect all that the scheme's limit connects."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    length = np.diff(np.r_[starts, len(key)])
    out = []
    for s, n in zip(starts[length > SHORT_RUN], length[length > SHORT_RUN], strict=True):
        if found := spanning(fp[s : s + n], scheme.limit):
            out.append(np.sort(rep[s : s + n][np.array(found)], axis=1))
    short = np.repeat((length > 1) & (length <= SHORT_RUN), length)
    key, rep, fp = key[short], rep[short], fp[short]
    for shift in range(1, SHORT_RUN):
        i = np.flatnonzero(key[shift:] == key[:-shift]) if len(key) > shift else key[:0]
        if not len(i):
            break
        i = i[_distance(fp[i], fp[i + shift]) <= scheme.limit]
        out.append(np.sort(np.stack([rep[i], rep[i + shift]], axis=1), axis=1))
    return out


def _linked(scheme: Scheme):
    """Links of a partition that is sorted by key; a run that crosses batches is held back until it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def links(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            found = _run_links(*(np.concatenate(x) for x in zip(*parts, strict=True)), scheme) if parts else []
            if found and len(pairs := np.unique(np.concatenate(found), axis=0)):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            key, rep = b.column(0).to_numpy(), b.column(1).to_numpy()
            fp = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint64).reshape(len(key), -1)
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield from links([*held, (key[:last], rep[:last], fp[:last])])
                held = []
            elif held and held[-1][0][-1] != key[0]:
                yield from links(held)
                held = []
            held.append((key[last:], rep[last:], fp[last:]))
        yield from links(held)

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(t.as_py(), k) for t in b.column(2).cast(pa.binary())]
            n = pa.array([len(x) for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n, pa.array([x.tobytes() for x in found], pa.binary())], ["id", "root", "n", "shingles"])

    return run


def _alike(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= similarity * max(1, len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in (b.column(0), b.column(1))], ["u", "v"])

    return run


def settle(ids: list[int], labels: list[int], first: list[bool], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links between sets alike by similarity that connect all that such links connect, where equal labels are connected already.

    Those that come first are compared with all, so of two blocks the one's members with the other's.
    """
    some = [i for i, x in enumerate(sets) if len(x)]
    if len(some) < 2:
        return []
    ids, labels, first, sets = ([v[i] for i in some] for v in (ids, labels, first, sets))
    inverse = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    size = np.array([len(x) for x in sets])
    at = np.r_[0, np.cumsum(size)]
    _, comp = np.unique(labels, return_inverse=True)
    mark, out = np.zeros(int(inverse.max()) + 1, bool), []
    for p in np.flatnonzero(first):
        apart = comp != comp[p]
        if not (apart & (np.minimum(size, size[p]) >= similarity * np.maximum(size, size[p]))).any():
            continue
        own = inverse[at[p] : at[p + 1]]
        mark[own] = True
        both = np.add.reduceat(mark[inverse], at[:-1], dtype=np.int64)
        mark[own] = False
        near = np.flatnonzero(apart & (both >= similarity * (size + size[p] - both)))
        for c, i in zip(*np.unique(comp[near], return_index=True), strict=True):
            out.append((ids[p], ids[near[i]]))
            comp[comp == c] = comp[p]
    return out


def _settled(similarity: float):
    """Links of a partition sorted by task, of rows task, first, id, label, shingles; a task's rows are held until it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows = None, []

        def links() -> Iterator[pa.RecordBatch]:
            first, ids, labels, sets = zip(*rows, strict=True)
            if found := settle(list(ids), list(labels), list(first), [np.frombuffer(x, np.uint64) for x in sets], similarity):
                u, v = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for b in batches:
            for t, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if t != task and rows:
                    yield from links()
                    rows = []
                task = t
                rows.append(row)
        if rows:
            yield from links()

    return run


def _in_blocks(big: DataFrame, star: DataFrame, block: int) -> DataFrame:
    """The members of large groups dealt to tasks, one for each two blocks of a group.

    What verified links connect and fills a block by itself has blocks of its own, which needn't meet each other; all else in
    a group shares blocks, which meet all blocks of the group and themselves.
    """
    labels = components(star).select(F.col("node").alias("_node"), F.col("root").alias("_label"))
    rows = big.join(labels, big["id"] == labels["_node"], "left").select("root", F.coalesce("_label", "id").alias("label"), "id", "n", "shingles")
    weight = rows.groupBy("root", "label").agg(F.sum("n").alias("w"))
    kind = weight.select("root", "label", "w", (F.col("w") > block).alias("own"), F.when(F.col("w") > block, F.col("label")).otherwise(F.lit(0)).alias("g"))
    count = kind.groupBy("root", "own", "g").agg(F.ceil(F.sum("w") / block).cast("long").alias("blocks"))
    placed = rows.join(kind.drop("w"), ["root", "label"]).join(count, ["root", "own", "g"])
    placed = materialize(placed.select("root", F.struct("own", "g", F.pmod(F.xxhash64("id"), "blocks").alias("b")).alias("at"), "id", "label", "shingles"), "blocks")
    blocks = placed.select("root", "at").distinct()
    one, two = blocks.select(F.col("root").alias("r"), F.col("at").alias("x")), blocks.select("root", F.col("at").alias("y"))
    pairs = one.join(two, one["r"] == two["root"]).where("x <= y and not (x.own and y.own and x.g = y.g)").select("r", "x", "y", F.xxhash64("r", "x", "y").alias("task"))
    pairs = materialize(pairs, "pairs")
    side = lambda c, p, first: placed.join(p.select("r", c, "task"), (placed["root"] == p["r"]) & (placed["at"] == p[c])).select("task", F.lit(first).alias("first"), "id", "label", "shingles")
    return side("x", pairs, True).union(side("y", pairs.where("x <> y"), False))


def _contracted(links: DataFrame) -> DataFrame:
    """Fewer links (u, v) that connect the same: each v to its least u, and that one to the other u of v.

    A document has few keys, so a v meets few u, though a u may meet any number of v; near copies that share many buckets
    would otherwise be linked once for each pivot.
    """
    met = links.groupBy("v").agg(F.collect_set("u").alias("us")).select(F.array_min("us").alias("m"), "v", "us")
    others = met.select("m", F.explode(F.array_remove("us", F.col("m"))).alias("v"))
    return met.select(F.col("m").alias("u"), "v").union(others.select(F.least("m", "v"), F.greatest("m", "v"))).distinct()


def _verified(links: DataFrame, own: DataFrame, words: int, similarity: float, block: int = BLOCK) -> DataFrame:
    """Links (u, v) that connect, of the documents that links connect, those that pairs alike by similarity do."""
    groups = components(links)
    sets = own.join(groups, own["id"] == groups["node"]).select("id", "root", "text").mapInArrow(_sets(words), "id long, root long, n long, shingles binary")
    sets = materialize(sets.groupBy("id").agg(F.max("root").alias("root"), F.max("n").alias("n"), F.max_by("shingles", "n").alias("shingles")), "shingles")
    large = materialize(sets.groupBy("root").agg(F.sum("n").alias("n")).where(F.col("n") > block).select(F.col("root").alias("large")), "large")
    rest = sets.join(large, sets["root"] == large["large"], "left_anti")
    tasks = rest.select(F.xxhash64("root").alias("task"), F.lit(True).alias("first"), "id", F.col("id").alias("label"), "shingles")
    star = None
    if not large.isEmpty():
        big = sets.join(large, sets["root"] == large["large"], "left_semi")
        side = lambda c, s: big.select(F.col("id").alias(c), F.col("shingles").alias(s))
        both = links.join(side("u", "_a"), "u").join(side("v", "_b"), "v").select("u", "v", "_a", "_b")
        star = materialize(both.mapInArrow(_alike(similarity), "u long, v long"), "star")
        tasks = tasks.union(_in_blocks(big, star, block))
    found = tasks.repartition("task").sortWithinPartitions("task", "id").mapInArrow(_settled(similarity), "u long, v long")
    return found.union(star) if star is not None else found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, scheme: Scheme | None = None, block: int = BLOCK) -> DataFrame:
    """(id_col: long, fingerprint: hex, component_id: long) for every row of docs, component_id the least id that links reach.

    Equal fingerprints are one node, whatever their number. A null text counts as empty, and texts without words have the
    fingerprint zero and link like any others. Rows with a null id are grouped but never name a group; repeated rows and
    repeated ids give a row each. An empty table gives an empty result; other columns of docs are ignored.
    """
    scheme = scheme or exact_scheme()
    python_workers(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketches = materialize(own.mapInArrow(_sketched(words, scheme.words, scheme.similarity is None), "id long, fp binary"), "sketches")
    nodes = sketches.groupBy("fp").agg(F.min("id").alias("rep"))
    keyed = nodes.where("rep is not null").select("rep", "fp").mapInArrow(_keyed(scheme), "key long, rep long, fp binary")
    links = keyed.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(_linked(scheme), "u long, v long")
    if scheme.similarity:
        links = _verified(materialize(_contracted(links), "links"), own, words, scheme.similarity, block)
    roots = components(links)
    named = nodes.join(roots, nodes["rep"] == roots["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return sketches.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.hex(F.col("fp").substr(1, 8))).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, block: int = BLOCK) -> DataFrame:
    """docs without those that are near copies of a document with a smaller id: one of each group stays.

    Rows with a null id stay. Rows that repeat an id are one document and stay or go together. block bounds the shingles
    that a task compares with as many others, and changes no result.
    """
    found = near_duplicates(docs, id_col, text_col, words, similarity_scheme(similarity), block)
    gone = found.where(f"`{id_col}` <> component_id").select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
