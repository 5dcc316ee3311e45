"""SimHash near-duplicates against brute force."""

import itertools
import random

import numpy as np
import pytest
import xxhash

from seriesmill.llm import golay, simhash
from seriesmill.llm.components import components


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, limit=3):
    fps = {}
    for doc, text in rows:
        fps.setdefault(brute_fingerprint(text), []).append(doc)
    names = list(fps)
    root = {f: f for f in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(names, 2):
        if (a ^ b).bit_count() <= limit:
            root[find(a)] = find(b)
    least = {}
    for f in names:
        for d in fps[f]:
            if d is not None:
                least[find(f)] = min(d, least.get(find(f), d))
    return sorted(((d, f"{f:016x}", least.get(find(f))) for f in names for d in fps[f]), key=str)


def test_golay_keys_forgive_two_errors():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 300, dtype=np.uint32)
    index, used = golay.keys(words)
    assert set(used.sum(axis=1)) <= {1, 6}
    for flips in [*itertools.combinations(range(23), 1), *itertools.combinations(range(23), 2)]:
        other, ok = golay.keys(words ^ np.uint32(sum(1 << b for b in flips)))
        for i in range(len(words)):
            assert set(index[i][used[i]]) & set(other[i][ok[i]])


def test_code_is_perfect():
    assert golay.tables()[3].min() >= 1


def test_three_errors_share_a_key():
    rng = random.Random(1)
    scheme = simhash.exact_scheme()

    def keys(v):
        out = set()
        for t, tab in enumerate(scheme.tables):
            index, used = golay.keys(np.array([v >> tab.fuzzy_at & ((1 << tab.fuzzy_bits) - 1)], np.uint32))
            out |= {(t, v >> tab.exact_at & 0xFFFF, int(k)) for k in index[0][used[0]]}
        return out

    for _ in range(3000):
        v = rng.getrandbits(64)
        w = v
        for b in rng.sample(range(64), rng.randint(1, 3)):
            w ^= 1 << b
        assert keys(v) & keys(w)


@pytest.mark.parametrize("limit", [3, 8])
def test_spanning_links_connect_what_all_links_do(limit):
    rng = random.Random(limit)
    fps = []
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(40):
            v = base
            for b in rng.sample(range(64), rng.randint(0, limit)):
                v ^= 1 << b
            fps.append(v)
    arr = np.array(fps, np.uint64).reshape(-1, 1)
    links = simhash.spanning(arr, limit)
    assert len(links) < len(fps)

    def groups(pairs):
        root = list(range(len(fps)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        return {frozenset(i for i in range(len(fps)) if find(i) == r) for r in {find(i) for i in range(len(fps))}}

    every = [(a, b) for a, b in itertools.combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= limit]
    assert groups(links) == groups(every)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, 50), (50, 70), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 1 for i in range(1, 31)) and got[100] == got[50] == got[70] == 50 and len(got) == 33
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_against_brute_force(sample):
    rows = [(r["doc_id"], r["text"]) for r in sample.collect()]
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(sample).collect()), key=str)
    assert got == brute_components(rows)


def test_near_copies_and_awkward_rows(documents, awkward, empty):
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(800)]
    rows = []
    for i in range(60):  # one large group of near copies
        w = list(words)
        if i:
            w[rng.randrange(800)] = f"n{i}"
        rows.append((i, " ".join(w), None, None, 0))
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(documents(rows)).collect()), key=str)
    assert got == brute_components([(r[0], r[1]) for r in rows])
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(awkward).collect()), key=str)
    assert got == brute_components([(r["doc_id"], r["text"]) for r in awkward.collect()])
    assert simhash.near_duplicates(empty).count() == 0


def test_long_texts_are_read_in_blocks():
    data = (" ".join(f"w{i}" for i in range(3000))).encode()
    from seriesmill.llm import common

    blocks = [w for b in common.word_blocks(data, 100) for w in b]
    assert blocks == data.split()
    whole = np.concatenate(list(simhash.shingle_hashes(data, 3)))
    old = simhash.word_blocks
    try:
        simhash.word_blocks = lambda d: common.word_blocks(d, 64)
        assert (np.concatenate(list(simhash.shingle_hashes(data, 3))) == whole).all()
    finally:
        simhash.word_blocks = old


def test_keep_one_by_similarity(documents, awkward, empty):
    rng = random.Random(9)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, same, apart = [], [], []
    for g in range(30):
        base = text(300)
        near, far = list(base), list(base)
        for p in range(3):
            near[40 + 100 * p] = f"n{g}{p}"  # 15 of 296 shingles differ: 0.90
        for p in range(0, 300, 12):
            far[p] = f"f{g}{p}"
        rows += [(10 * g, " ".join(base), None, None, 0), (10 * g + 1, " ".join(near), None, None, 0), (10 * g + 2, " ".join(far), None, None, 0)]
        same.append(10 * g + 1)
        apart.append(10 * g + 2)
    docs = documents(rows).selectExpr("*", "'x' AS component_id", "1 AS fingerprint", "2 AS _gone")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert not ids & set(same) and set(apart) <= ids and {10 * g for g in range(30)} <= ids
    assert {r["doc_id"] for r in simhash.keep_one(awkward).collect()} >= {None, 4, 5, 6, 7, 8}
    assert simhash.keep_one(empty).count() == 0


def variants(rng, n, words, shared):
    """n texts that keep each part of a common text with a chance that makes their shingle sets alike by about shared."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for p in range(0, words, 20):
            if rng.random() < shared:
                w[p + rng.randrange(20)] = f"v{i}{p}"
        out.append(" ".join(w))
    return out


def connected(texts, similarity=0.8):
    """The least index that links reach, for each text, by comparing all pairs of shingle sets."""
    sets = [simhash.shingle_set(t.encode(), 5) for t in texts]
    labels = list(range(len(texts)))
    links = simhash.settle(list(range(len(texts))), labels, [True] * len(texts), sets, similarity)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in labels]


def test_settling_equals_all_pairs():
    rng = random.Random(12)
    for share in (0.3, 0.6, 0.75):
        texts = variants(rng, 40, 200, share)
        sets = [set(simhash.shingle_set(t.encode(), 5).tolist()) for t in texts]
        root = list(range(len(texts)))
        for a, b in itertools.combinations(range(len(texts)), 2):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
        assert connected(texts) == root


def test_only_near_copies_go_from_groups_of_any_size(documents):
    rng = random.Random(11)
    texts, at = [], []
    for n, share in ((2, 0.55), (8, 0.55), (9, 0.55), (40, 0.5), (40, 0.55), (40, 0.6), (1000, 0.52), (300, 0.3)):
        at.append(len(texts))
        texts += variants(rng, n, 400, share)
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)]
    root = connected(texts)
    gone = {i for i, r in enumerate(root) if r != i}
    assert 100 < len(gone) < len(texts) - 400  # many documents have no partner, many have
    results = []
    for block in (simhash.BLOCK, 30_000):
        kept = {r["doc_id"] for r in simhash.keep_one(documents(rows), block=block).collect()}
        results.append(kept)
        dropped = set(range(len(texts))) - kept
        assert dropped <= gone
        assert len(dropped) >= 0.99 * len(gone)
    assert results[0] == results[1]


def test_results_do_not_depend_on_short_runs(monkeypatch):
    rng = random.Random(13)
    texts = [t for n in (3, 9, 40) for t in variants(rng, n, 300, 0.5)]
    scheme = simhash.similarity_scheme()
    fp = np.frombuffer(b"".join(simhash.fingerprint(t.encode(), 5, scheme.words, False)[: 8 * scheme.compared] for t in texts), np.uint64).reshape(len(texts), -1)
    found = []
    for short in (2, 8, 100):
        monkeypatch.setattr(simhash, "SHORT_RUN", short)
        links = simhash._run_links(np.zeros(len(texts), np.int64), np.arange(len(texts)), fp, scheme)
        root = list(range(len(texts)))
        for a, b in np.concatenate(links).tolist():
            x, y = sorted((root[a], root[b]))
            root = [x if r == y else r for r in root]
        found.append(root)
    assert found[0] == found[1] == found[2]


def test_repeated_shingles_count_once_between_copies(documents):
    rng = random.Random(14)
    part, rest = ([f"w{rng.randrange(10**6)}" for _ in range(n)] for n in (60, 340))
    texts = [" ".join(part + rest), " ".join(part * 10 + rest)]
    kept = simhash.keep_one(documents([(i, t, None, None, 0) for i, t in enumerate(texts)])).collect()
    assert [r["doc_id"] for r in kept] == [0]
