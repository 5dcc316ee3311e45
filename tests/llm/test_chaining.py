"""Repeated passages: seeds, chains against brute force, planted passages."""

import random

import numpy as np
import pyarrow as pa

from seriesmill.llm import chaining as C


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_shared_runs_share_seeds():
    rng = random.Random(0)
    for _ in range(200):
        core = words(rng, C.K + C.W - 1)
        a = C.word_hashes(" ".join(words(rng, rng.randint(0, 40)) + core + words(rng, 30)).encode())
        b = C.word_hashes(" ".join(words(rng, rng.randint(0, 40)) + core).encode())
        assert set(C.seeds(a)[0]) & set(C.seeds(b)[0])


def brute_score(x, y, k, cost, gap):
    n = len(x)
    best = [float(k)] * n
    for i in range(n):
        for j in range(i):
            dx, dy = x[i] - x[j], y[i] - y[j]
            if 0 < dx <= gap and 0 < dy <= gap:
                best[i] = max(best[i], best[j] + min(k, dx, dy) - cost * (max(0, dx - k) + max(0, dy - k)))
    return max(best, default=0)


def chain_score(c, x, y, k, cost):
    s = float(k)
    for i, j in zip(c, c[1:], strict=False):
        dx, dy = x[j] - x[i], y[j] - y[i]
        assert dx > 0 and dy > 0
        s += min(k, dx, dy) - cost * (max(0, dx - k) + max(0, dy - k))
    return s


def test_chains_are_collinear_and_near_the_best():
    rng = random.Random(1)
    for _ in range(100):
        n = rng.randint(1, 40)
        pts = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(n)} | {(100 + 9 * i, 200 + 9 * i) for i in range(8)})
        x, y = np.array([p[0] for p in pts]), np.array([p[1] for p in pts])
        found = C.chains(x, y)
        assert sorted(i for c in found for i in c) == list(range(len(pts)))
        top = max(chain_score(c, x, y, C.K, C.GAP_COST) for c in found)
        assert top >= 0.85 * brute_score(x, y, C.K, C.GAP_COST, C.MAX_GAP)


def test_fenwick_maxima():
    rng = random.Random(2)
    tree, held = C.Fenwick(50), {}
    for i in range(300):
        p, v = rng.randrange(50), rng.random()
        tree.add(p, v, i)
        held[p] = max(v, held.get(p, -1))
        q = rng.randrange(51)
        want = max((v for p, v in held.items() if p < q), default=-np.inf)
        assert tree.before(q)[0] == want


def test_matches_link_every_occurrence_across_batches():
    rng = random.Random(3)
    rows = sorted({(rng.randrange(30), rng.randrange(12), rng.randrange(40)) for _ in range(400)})
    want = set()
    for i, (s, d, p) in enumerate(rows):
        same = [r for r in rows[:i] if r[0] == s]
        if same and same[0][1] != d:
            want.add((d, same[0][1], p, same[0][2]))
            before = [r for r in same if r[1] != d][-1]
            want.add((d, before[1], p, before[2]))
    for size in (1, 7, 400):
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32()))], ["seed", "doc", "at"]) for part in parts]
        got = {r for b in C._matched(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)}
        assert got == want


def test_edit_distance_and_extension():
    rng = random.Random(4)
    for _ in range(100):
        a, b = ([rng.randrange(3) for _ in range(rng.randint(0, 9))] for _ in range(2))
        d = [[max(i, j) if not min(i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        assert C.edit_distance(np.array(a, int), np.array(b, int)) == d[-1][-1]
    x = np.arange(20)
    y = np.r_[x[:8], 99, x[9:20], 50, 51]
    assert C.extend(x, y) == (20, 20, 1)


def test_planted_passages(documents, awkward, empty):
    rng = random.Random(5)
    shared, fuzzy = words(rng, 55), words(rng, 120)
    rows = []
    for d in range(40):
        body = words(rng, 150)
        if d < 20:
            body[30:30] = shared
        elif d < 25:
            copy = list(fuzzy)
            for p in range(13 + d, 120, 25):
                copy[p] = f"x{d}{p}"
            body[60:60] = copy
        rows.append((d, " ".join(body), None, None, 0))
    found = C.repeated_passages(documents(rows)).collect()
    linked = {r["doc_id"] for r in found} | {r["other_id"] for r in found}
    assert linked == set(range(25)) and len(set(found)) == len(found)
    for r in found:
        assert r["other_id"] < r["doc_id"]
        if r["doc_id"] < 20:
            assert (r["start"], r["stop"], r["other_start"], r["other_stop"], r["n_errors"]) == (30, 85, 30, 85, 0)
        else:
            assert r["stop"] - r["start"] >= 50 and 0.8 <= r["identity"] < 1
    root = {d: d for d in range(25)}
    for r in sorted(found, key=lambda r: r["doc_id"]):
        root[r["doc_id"]] = root[r["other_id"]]
    assert len({root[d] for d in range(20)}) == 1 and len({root[d] for d in range(20, 25)}) == 1
    assert C.repeated_passages(awkward).count() == 0 and C.repeated_passages(empty).count() == 0


def test_passages_within_longer_chains_to_other_documents_stay(documents):
    rng = random.Random(6)
    exact = words(rng, 80)  # in 0 and 2; also in 1, amid a text that is too much edited
    around = [words(rng, 16) for _ in range(8)]
    edited = lambda: [w for part in around for w in part + words(rng, 16)]
    whole, more = words(rng, 80), [words(rng, 60), words(rng, 60)]  # 10 and 13 share whole, 11 and 12 half of it each and more
    rows = [
        (0, words(rng, 40) + exact + words(rng, 40)),
        (1, edited() + exact + words(rng, 40)),
        (2, edited() + exact + words(rng, 50)),
        (10, words(rng, 40) + whole + words(rng, 40)),
        (11, more[0] + whole[:40] + words(rng, 40)),
        (12, words(rng, 40) + whole[40:] + more[1]),
        (13, more[0] + whole + more[1]),
    ]
    found = C.repeated_passages(documents([(d, " ".join(t), None, None, 0) for d, t in rows])).collect()
    spans = {(r["doc_id"], r["other_id"]): (r["start"], r["stop"], r["other_start"], r["other_stop"]) for r in found}
    assert spans[2, 0] == (256, 336, 40, 120)
    assert spans[13, 10] == (60, 140, 40, 120)


def brute_passages(a, b, xs, ys, least, identity):
    """All parts of a chain between two of its seeds that are long and alike enough, unextended."""
    for i in range(len(xs)):
        for j in range(i, len(xs)):
            s, e, t, f = xs[i], xs[j] + C.K, ys[i], ys[j] + C.K
            if min(e - s, f - t) >= least and 1 - C.edit_distance(a[s:e], b[t:f]) / max(e - s, f - t) >= identity:
                yield s, e, t, f


def test_parts_of_chains_that_are_too_much_edited_as_a_whole(documents):
    rng = random.Random(7)
    one, two, phrase, three = (words(rng, n) for n in (60, 60, 16, 60))
    texts = [one + words(rng, 35) + two + words(rng, 90) + phrase + words(rng, 30) + three for _ in range(2)]
    found = C.repeated_passages(documents([(d, " ".join(t), None, None, 0) for d, t in enumerate(texts)])).collect()
    assert sorted((r["start"], r["stop"], r["other_start"], r["other_stop"], r["n_errors"]) for r in found) == [(s, s + 60, s, s + 60, 0) for s in (0, 95, 291)]

    for _ in range(60):
        a, b = [], []
        for _ in range(rng.randint(2, 9)):
            same = [rng.randrange(10**6) for _ in range(rng.choice((20, 30, 60)))]
            gap = rng.choice((1, 4, 12, 35))
            a += same + [rng.randrange(10**6) for _ in range(gap)]
            b += same + [rng.randrange(10**6) for _ in range(gap + rng.choice((0, 0, 2)))]
        a, b = np.array(a, np.uint64), np.array(b, np.uint64)
        (sa, xs), (sb, ys) = C.seeds(a), C.seeds(b)
        both, i, j = np.intersect1d(sa, sb, return_indices=True)
        xs, ys = np.sort(xs[i]), np.sort(ys[j])
        got = C.passages(a, b, xs, ys, C.K, 50, 0.8)
        for s, e, t, f, errors in got:
            assert min(e - s, f - t) >= 50 and 1 - errors / max(e - s, f - t) >= 0.8
        for s, e, t, f in brute_passages(a, b, xs.tolist(), ys.tolist(), 50, 0.8):
            assert any(g[0] <= s and e <= g[1] and g[2] <= t and f <= g[3] for g in got)


def test_long_words_and_blocks():
    t = ("word " * 10 + "y" * 100 + "\x0b\x0c z").encode()
    assert len(C.word_hashes(t)) == 12 and len(C.word_hashes(b"")) == 0


def test_pairs_taken_together_equal_the_recurrence():
    rng = random.Random(8)
    for _ in range(60):
        rows = []
        for pair in range(rng.randint(1, 12)):
            x, y = rng.randrange(50), rng.randrange(50)
            for _ in range(rng.randint(1, 12)):
                rows.append((9, pair, x, y))
                step = rng.choice((1, 3, 8, 12, 23, 24, 30, 61))
                x, y = x + step, y + step + (rng.random() < 0.1)
        t = np.array(sorted(set(rows)))
        got = C._chains_of(t, C.K, 1).to_pylist()
        want = []
        for pair in sorted(set(t[:, 1].tolist())):
            own = t[t[:, 1] == pair]
            for c in C.chains(own[:, 2], own[:, 3]):
                xs, ys, ns, _ = C._merged(own[c, 2], own[c, 3], np.arange(len(c)) == 0, C.K)
                want.append({"a": 9, "b": pair, "xs": xs.tolist(), "ys": ys.tolist(), "ns": ns.tolist()})
        key = lambda r: str(sorted(r.items()))
        assert sorted(got, key=key) == sorted(want, key=key)


def shared_exactly(a, b, least):
    """The longest runs of equal words of two texts, of least words or more, by comparing all places."""
    out, n = [], [0] * (len(b) + 1)
    for i, x in enumerate(a):
        row = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                row[j + 1] = n[j] + 1
                if row[j + 1] >= least and (i + 1 == len(a) or j + 1 == len(b) or a[i + 1] != b[j + 1]):
                    out.append((i + 1 - row[j + 1], i + 1, j + 1 - row[j + 1], j + 1))
        n = row
    return out


def test_recall_against_all_pairs(documents):
    """Two exact passages a pair, 10 to 60 words apart: all pairs of places are compared, no passage may be missing."""
    rng = random.Random(10)
    texts = []
    for d in range(150):
        one, two, gap = words(rng, 55), words(rng, 55), 10 + d % 51
        for _ in range(2):
            texts.append(words(rng, 20) + one + words(rng, gap) + two + words(rng, 25))
    found = C.repeated_passages(documents([(d, " ".join(t), None, None, 0) for d, t in enumerate(texts)])).collect()
    assert len(set(found)) == len(found)
    got = {}
    for r in found:
        got.setdefault((r["other_id"], r["doc_id"]), []).append((r["other_start"], r["other_stop"], r["start"], r["stop"]))
    want = missed = 0
    for d in range(0, 300, 2):
        for s, e, t, f in shared_exactly(texts[d], texts[d + 1], 50):
            want += 1
            missed += not any(p <= s and e <= q and u <= t and f <= v for p, q, u, v in got.get((d, d + 1), []))
    assert want == 300 and missed <= 0.05 * want
    assert set(got) <= {(d, d + 1) for d in range(0, 300, 2)}
    print("exact passages found", want - missed, "of", want)


def test_recall_of_edited_passages(documents):
    """Passages of 60 words of which a share is replaced; the README states these figures."""
    rng = random.Random(15)
    rows, pairs = [], {}
    for share in (0.05, 0.1, 0.15, 0.19):
        for _ in range(100):
            core, d = words(rng, 60), len(rows)
            at = set(rng.sample(range(60), round(60 * share)))
            copy = [f"x{d}{i}" if i in at else w for i, w in enumerate(core)]
            rows += [(d, " ".join(words(rng, 30) + core + words(rng, 30)), None, None, 0), (d + 1, " ".join(words(rng, 30) + copy + words(rng, 30)), None, None, 0)]
            pairs[d + 1] = share
    hit = {r["doc_id"] for r in C.repeated_passages(documents(rows)).collect()}
    recall = {s: sum(d in hit for d, t in pairs.items() if t == s) / 100 for s in sorted(set(pairs.values()))}
    print("recall by share of replaced words", recall)
    assert recall[0.05] >= 0.98 and recall[0.1] >= 0.85


def test_partners_that_are_neither_first_nor_before(documents):
    """Documents with a passage whose halves, short of 50 words each, other documents hold before and between them."""
    rng = random.Random(16)
    rows, want = [], set()
    line = words(rng, 20)
    for case in range(12):
        exact, d = words(rng, 80), 10 * case
        whole = exact if case % 2 else [f"x{case}{i}" if i in (11, 33, 52, 70) else w for i, w in enumerate(exact)]
        for i, part in enumerate((exact[:40], exact[40:], exact, exact[:40], exact[40:], whole)):
            rows.append((d + i, words(rng, 60) + part + words(rng, 60)))
        want.add((d + 5, d + 2))
    for i in range(120):  # a line of which most pairs share no more; some also share what follows it, amid others that don't
        rows.append((1000 + i, words(rng, 40) + line + words(rng, 60)))
    for i, d in enumerate((1031, 1032, 1090)):
        if i == 0:
            after = words(rng, 40)
        rows[[r[0] for r in rows].index(d)] = (d, words(rng, 40) + line + after + words(rng, 60))
    want |= {(1090, 1031), (1090, 1032), (1032, 1031)}
    found = C.repeated_passages(documents([(d, " ".join(t), None, None, 0) for d, t in rows])).collect()
    assert len(set(found)) == len(found)
    linked = {(r["doc_id"], r["other_id"]) for r in found}
    assert {(d, o) for d, o in linked if d < 1000} == {p for p in want if p[0] < 1000}
    near = {d: d for d, _ in rows}
    for d, o in sorted(linked):
        near[d] = near[o]
    assert all(near[d] == near[o] for d, o in want)
    assert {d for p in linked for d in p if d >= 1000} == {1031, 1032, 1090}


def test_classes_of_a_seed():
    assert C.classes([(2, 1, True), (3, 1, False), (3, 2, True)]) == {1: 1, 2: 1, 3: 1}
    assert C.classes([(2, 1, True), (3, 1, False), (3, 2, False)]) == {1: 1, 2: 1, 3: 3}
    assert C.classes([(1, 1, False), (2, 1, True), (3, 1, False), (3, 2, True)]) == {1: 1, 2: 2, 3: 2}


def test_may_share_drops_no_pair_with_a_passage():
    rng = random.Random(17)
    for trial in range(30):
        line, cores, texts = words(rng, 16), [words(rng, 45) for _ in range(3)], []
        for _ in range(24):
            edits = set(rng.sample(range(45), rng.choice((0, 2, 5, 7))))
            core = [w for i, w in enumerate(rng.choice(cores)) for w in ([] if i in edits and rng.random() < 0.3 else [f"y{rng.random()}" if i in edits else w])]
            texts.append(words(rng, rng.randrange(130)) + line + words(rng, rng.choice((0, 0, 3))) + (core if rng.random() < 0.6 else words(rng, 50)) + words(rng, rng.randrange(130)))
        hashed = [C.word_hashes(" ".join(t).encode()) for t in texts]
        shared = set.intersection(*(set(C.seeds(h)[0].tolist()) for h in hashed))
        if not shared:
            continue
        seed = min(shared)
        at = [int(p[h.tolist().index(seed)]) for h, p in map(C.seeds, hashed)]
        around = [((h >> np.uint64(32)).astype(np.uint32)[max(0, p - C.SEEN) : p + C.K + C.SEEN], min(p, C.SEEN)) for h, p in zip(hashed, at, strict=True)]
        got = {p for i, j in C.may_share([v for v, _ in around], [p for _, p in around], np.arange(24), cells=rng.choice((24, 100, 1 << 22))) for p in zip(i.tolist(), j.tolist(), strict=True)}
        for i in range(24):
            for j in range(i + 1, 24):
                (si, xi), (sj, xj) = C.seeds(hashed[i]), C.seeds(hashed[j])
                pts = sorted((int(p), int(q)) for s, p in zip(si, xi, strict=True) for q in xj[sj == s])
                x, y = np.array([p for p, _ in pts]), np.array([q for _, q in pts])
                for c in C.chains(x, y):
                    ok = C.passages(hashed[i], hashed[j], x[c], y[c], C.K, 50, 0.8)
                    if any(s <= at[i] and at[i] + C.K <= e and t <= at[j] and at[j] + C.K <= f for s, e, t, f, _ in ok):
                        assert (i, j) in got, (trial, i, j)


def test_pairs_left_in_lots_give_the_same_rows(documents, monkeypatch):
    rng = random.Random(21)
    rows = []
    for g in range(6):
        core = words(rng, 60)
        for d in range(8):
            copy = [w if rng.random() > 0.12 else f"x{g}{d}{i}" for i, w in enumerate(core)]
            rows.append((8 * g + d, " ".join(words(rng, 70) + copy + words(rng, 70)), None, None, 0))
    written = []
    real = C.materialize
    monkeypatch.setattr(C, "materialize", lambda df, name: written.append(name) or real(df, name))
    whole = set(C.repeated_passages(documents(rows)).collect())
    assert whole and written.count("more") == 1
    written.clear()
    monkeypatch.setattr(C, "PAIRS", (5, 0))
    assert set(C.repeated_passages(documents(rows)).collect()) == whole and written.count("more") > 1


def test_words_asked_for_are_sent_in_bounded_batches():
    text = " ".join(f"w{i}" for i in range(1000))
    n = 3000
    asked = [[{"chain": 500 * r + i, "side": 0, "first": i - 64, "last": i + 136} for i in range(500)] for r in range(n // 500)] * 10
    kind = pa.list_(pa.struct([("chain", pa.int64()), ("side", pa.int32()), ("first", pa.int32()), ("last", pa.int32())]))
    b = pa.RecordBatch.from_arrays([pa.array([text] * len(asked)), pa.array(asked, kind)], ["text", "asked"])
    found = list(C._fetched(iter([b])))
    assert max(x.nbytes for x in found) < 2 * C.BYTES and sum(x.num_rows for x in found) == 10 * n
    want = (C.word_hashes(text.encode()) >> np.uint64(32)).astype(np.uint32)
    at = 0
    for x in found:
        for r in x.to_pylist():
            first = asked[at // 500][at % 500]
            lo = max(0, first["first"])
            assert (r["chain"], r["lo"]) == (first["chain"], lo) and r["words"] == want[lo : first["last"]].tobytes()
            at += 1


def test_steps_on_many_texts_at_once_are_those_on_each():
    rng = random.Random(22)
    texts = [bytes(rng.choice(b"aAbB \n\x0b\xc3\xa9") for _ in range(rng.randrange(300))) for _ in range(200)] + [b"", b" ", b" ".join(b"Q" * n for n in range(70))]
    hashed = C.hashes_of(texts)
    assert [h.tolist() for h in hashed] == [C.word_hashes(t).tolist() for t in texts]
    number, h, at = C.seeds_of(hashed)
    assert [(h[number == i].tolist(), at[number == i].tolist()) for i in range(len(texts))] == [tuple(x.tolist() for x in C.seeds(t)) for t in hashed]
    pairs = [[[rng.randrange(4) for _ in range(rng.randrange(C.MARGIN + 1))] for _ in range(2)] for _ in range(2000)]
    pairs += [[a, [x for x in a if rng.random() > 0.05]] for a, _ in pairs]
    rows = [np.array([p[s] + [fill] * (C.MARGIN + 3 - len(p[s])) for p in pairs]) for s, fill in ((0, -1), (1, -2))]
    assert list(zip(*(x.tolist() for x in C.extend_all(*rows)), strict=True)) == [C.extend(np.array(a, int), np.array(b, int)) for a, b in pairs]
