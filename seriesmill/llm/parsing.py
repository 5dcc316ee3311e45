"""Document fingerprints by locally consistent parsing.

A text is a sequence of symbols, at first its code points. Runs of one symbol become one symbol; then deterministic coin
tossing gives each symbol a label from its lowest bit that differs from its left neighbour's, again and again, until
labels are a few bits and neighbours still differ. Symbols whose label is a local maximum start phrases. A phrase's name is
a hash of its symbols, and names are the symbols of the next level. Names depend on a few neighbours only, so equal
substrings get equal names inside, wherever they stand. A fingerprint keeps the least hashed names of each level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

LEVELS = 3
#: Names kept for each level, lowest level first, and the fewest names by which a level is trusted.
KEPT = (16, 32, 64)
ENOUGH = 8
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _starts(symbols: np.ndarray, first: np.ndarray, rounds: int) -> np.ndarray:
    """Where phrases start. first: where texts start; neighbours within a text differ."""
    label = symbols
    for _ in range(rounds):
        left = np.empty_like(label)
        left[1:] = label[:-1]
        left[first] = ~label[first]
        diff = label ^ left
        low = np.bitwise_count((diff & (~diff + _U(1))) - _U(1)).astype(np.uint64)
        label = (low << _U(1)) | ((label >> low) & _U(1))
    rise = np.ones(len(label), bool)
    fall = np.ones(len(label), bool)
    rise[1:] = label[1:] > label[:-1]
    fall[:-1] = label[:-1] > label[1:]
    fall[first[1:] - 1] = True  # what follows a text has no say in it
    out = rise & fall
    out[first] = True
    return out


def _named(symbols: np.ndarray, starts: np.ndarray, salt: int) -> np.ndarray:
    """A name for each phrase: its symbols, each hashed with its place in the phrase, added up."""
    at = np.flatnonzero(starts)
    place = np.arange(len(symbols), dtype=np.int64) - np.repeat(at, np.diff(np.r_[at, len(symbols)]))
    return mix(np.add.reduceat(mix(symbols + (place.astype(np.uint64) + _U(1)) * _ODD), at) + _U(salt))


def parse(symbols: np.ndarray, doc: np.ndarray, levels: int = LEVELS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each level, names and the text that each belongs to. doc: the text of each symbol, in rising order."""
    for level in range(levels):
        new = np.ones(len(symbols), bool)
        new[1:] = (symbols[1:] != symbols[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        length = np.diff(np.r_[at, len(symbols)]).astype(np.uint64)
        symbols, doc = symbols[at], doc[at]
        if not len(symbols):
            yield symbols, doc
            continue
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        starts = _starts(symbols, first, 3 if level == 0 else 4)
        names = _named(symbols + length * _U(0xD1B54A32D192ED03), starts, level + 1)
        symbols, doc = names, doc[starts]
        yield symbols, doc


def fingerprints(texts: list[np.ndarray], at_once: int = 1 << 18) -> list[list[np.ndarray]]:
    """Of texts as code points, per text and level: the least distinct 32-bit hashes of its names, rising.

    Texts are parsed together up to at_once symbols; a longer text is parsed alone, in memory of about 100 bytes a symbol.
    """
    out: list[list[np.ndarray]] = []
    group: list[np.ndarray] = []
    total = 0
    for t in texts:
        if group and total + len(t) > at_once:
            out += _fingerprints(group)
            group, total = [], 0
        group.append(t)
        total += len(t)
    return out + (_fingerprints(group) if group else [])


def _fingerprints(texts: list[np.ndarray]) -> list[list[np.ndarray]]:
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    symbols = mix(np.concatenate(texts).astype(np.uint64) + _U(1)) if len(doc) else np.zeros(0, np.uint64)
    out: list[list[np.ndarray]] = [[] for _ in texts]
    for k, (names, owner) in zip(KEPT, parse(symbols, doc), strict=True):
        packed = (owner.astype(np.uint64) << _U(32)) | (names >> _U(32))
        packed.sort()
        packed = packed[np.r_[True, packed[1:] != packed[:-1]]] if len(packed) else packed
        edge = np.searchsorted(packed, np.arange(len(texts) + 1).astype(np.uint64) << _U(32))
        for i in range(len(texts)):
            out[i].append(packed[edge[i] : min(edge[i + 1], edge[i] + k)].astype(np.uint32))
    return out


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> float:
    """Estimated Jaccard similarity of the names at the highest level at which both have enough of them; 1 if all are equal."""
    if all(np.array_equal(x, y) for x, y in zip(a, b, strict=True)):
        return 1.0
    for level in range(LEVELS - 1, -1, -1):
        x, y, k = a[level], b[level], KEPT[level]
        if level and min(len(x), len(y)) < ENOUGH:
            continue
        both = np.union1d(x, y)[:k]
        if not len(both):
            return 0.0
        return float(np.isin(both, x).dot(np.isin(both, y).astype(np.int64)) / len(both))
    return 0.0


def text_of(fp: list[np.ndarray]) -> str:
    """A fingerprint as a string: each level's hashes in hexadecimal, levels parted by a colon."""
    return ":".join(level.astype(">u4").tobytes().hex() for level in fp)


def parsed(text: str) -> list[np.ndarray]:
    """The fingerprint that text_of wrote."""
    return [np.frombuffer(bytes.fromhex(x), ">u4").astype(np.uint32) for x in text.split(":")]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def fingerprint(text: str | None) -> str:
    """The fingerprint of one text; a null or empty one has no names at any level."""
    return text_of(fingerprints([code_points(text or "")])[0])


@dataclass
class _Doc:
    id: int | None
    points: np.ndarray
    fp: list[np.ndarray]


def edited(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """own with its last third replaced by as many code points (or all) of other's start."""
    m = len(own) // 3
    return np.concatenate([own[: len(own) - m], other[:m]])


def document_batch(docs: list[tuple[int | None, str]]) -> list[_Doc]:
    points = [code_points(t) for _, t in docs]
    return [_Doc(i, p, f) for (i, _), p, f in zip(docs, points, fingerprints(points), strict=True)]


def to_arrow(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))
