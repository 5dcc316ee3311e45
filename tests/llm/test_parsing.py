"""Locally consistent parsing and the fingerprints of edited documents."""

import hashlib
import random

import numpy as np

from seriesmill.llm import neighbours
from seriesmill.llm import parsing as P


def text(rng, n):
    return "".join(rng.choice("abcdefghij klmno") for _ in range(n))


def names(t):
    points = P.mix(P.code_points(t).astype(np.uint64) + np.uint64(1))
    return [n for n, _ in P.parse(points, np.zeros(len(points), np.int64))]


def test_equal_substrings_share_interior_names():
    rng = random.Random(0)
    core = text(rng, 2000)
    a, b = names(text(rng, 137) + core + text(rng, 50)), names(text(rng, 20) + core + text(rng, 333))
    alone = names(core)
    for level in range(P.LEVELS):
        inside = list(alone[level][8:-8])
        for other in (a[level], b[level]):
            joined = other.tobytes()
            assert np.array(inside, np.uint64).tobytes() in joined


def test_levels_shrink_and_runs_collapse():
    rng = random.Random(1)
    sizes = [len(n) for n in names(text(rng, 5000))]
    assert sizes[0] <= 2600 and sizes[1] <= sizes[0] / 2 and sizes[2] <= sizes[1] / 2
    assert len(names("a" * 10_000)[0]) == 1
    assert names("a" * 10)[0][0] != names("a" * 11)[0][0]


def test_batches_do_not_matter():
    rng = random.Random(2)
    texts = [P.code_points(text(rng, rng.randint(0, 400))) for _ in range(60)]
    together = [P.text_of(f) for f in P.fingerprints(texts)]
    assert together == [P.text_of(P.fingerprints([t])[0]) for t in texts] == [P.text_of(f) for f in P.fingerprints(texts, 300)]
    assert [P.text_of(P.parsed(t)) for t in together] == together


def test_likeness():
    rng = random.Random(3)
    a, b = text(rng, 6000), text(rng, 6000)
    fp = lambda t: P.parsed(P.fingerprint(t))
    assert P.likeness(fp(a), fp(a)) == 1 and P.likeness(fp(""), fp("")) == 1 and P.likeness(fp(""), fp(a)) == 0
    assert P.likeness(fp(a), fp(b)) < 0.1
    assert 0.3 < P.likeness(fp(a), fp(a[:4000] + b[:2000])) < 0.7
    assert P.fingerprint(None) == P.fingerprint("")


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, (doc, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        m = len(t) // 3
        edited = t[: len(t) - m] + nxt[:m]
        own, new, other = (P.parsed(P.fingerprint(x)) for x in (t, edited, nxt))
        out.append((doc, len(t), hashlib.sha256(edited.encode()).hexdigest(), P.fingerprint(t), P.fingerprint(edited), P.likeness(own, new), P.likeness(own, other)))
    return sorted(out, key=str)


def test_against_brute_force(sample):
    got = sorted((tuple(r) for r in neighbours.edited_likeness(sample).collect()), key=str)
    assert got == brute([(r["doc_id"], r["text"]) for r in sample.collect()])
    assert np.mean([r[5] > r[6] for r in got]) > 0.97


def test_awkward_rows(documents, awkward, empty):
    got = sorted((tuple(r) for r in neighbours.edited_likeness(awkward).collect()), key=str)
    assert got == brute([(r["doc_id"], r["text"]) for r in awkward.collect()])
    assert neighbours.edited_likeness(empty).count() == 0
    one = documents([(3, "a single document", None, None, 0)])
    assert [tuple(r) for r in neighbours.edited_likeness(one).collect()] == brute([(3, "a single document")])
    nobody = documents([(None, "a", None, None, 0), (None, "b", None, None, 0)])
    assert sorted((tuple(r) for r in neighbours.edited_likeness(nobody).collect()), key=str) == brute([(None, "a"), (None, "b")])
    plain = neighbours.fingerprint_documents(awkward)
    assert {r["fingerprint"] for r in plain.collect()} == {P.fingerprint(r["text"]) for r in awkward.collect()}
