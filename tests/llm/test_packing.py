"""Packing: ids against the tokenizer, pieces, gapless offsets, fill."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seriesmill.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain(specials_as_text=False):
    t = Tokenizer.from_file(PATH)
    if specials_as_text:
        t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_ids_equal_the_tokenizers(sample):
    encode, want = packing.encoder(PATH), plain()
    texts = [r["text"] for r in sample.collect()] + ["", " ", "a" * 3000, "<|endoftext|>x", "日本語　🙂́", "\x02\x03\n\n  x", "don't WE'LL 12,345"]
    texts += ["a<|endoftext|>b", "<|endoftext|><|endoftext|>", "x <|endoftext| > y", "end <|endoftext|>"]
    for t in texts:
        assert encode(t) == want(t)
    assert encode("a<|endoftext|>b") == [64, 50256, 65]
    encode, want = packing.encoder(PATH, True), plain(True)
    for t in texts:
        assert encode(t) == want(t)


def test_other_tokenizer_files_work():
    path = public_tokenizers.path("word_bpe_49k.json")
    assert packing.encoder(path)("Hello there") == Tokenizer.from_file(path).encode("Hello there", add_special_tokens=False).ids


def test_cuts():
    assert packing.cuts(10, 10) == [(0, 10)]
    assert packing.cuts(11, 10) == [(0, 1), (1, 10)]
    assert packing.cuts(20, 10) == [(0, 10), (10, 10)]


def test_best_fit_is_best():
    rng = random.Random(0)
    sizes = [rng.randint(1, 100) for _ in range(300)]
    bins, offsets, fills = packing.best_fit(sizes, 100)
    rooms: list[int] = []
    for s, b, o in zip(sizes, bins, offsets, strict=True):
        fitting = [r for r in rooms if r >= s]
        if fitting:
            assert 100 - o == min(fitting)
            rooms.remove(100 - o)
        else:
            assert o == 0
        if 100 - o - s:
            rooms.append(100 - o - s)
    assert max(fills) <= 100 and sum(fills) == sum(sizes)


def test_useful_bounds_what_climbs():
    up = packing.useful(np.array([60] * 50 + [40, 99]), 100, 0.98, 3)
    assert up.sum() == 4 and up[50] and not up[51]


def check(out, capacity):
    seqs = defaultdict(list)
    for r in out.collect():
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    total = 0
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
        total += at
    return len(seqs), -(-total // capacity)


@pytest.mark.parametrize("rows_per_leaf", [7, 1000])
def test_documents_are_packed_whole(sample, rows_per_leaf):
    from seriesmill.llm.common import materialize

    pieces = materialize(packing.token_pieces(sample, PATH, with_ids=True), "pieces")
    out = packing.pack(pieces, 2048, rows_per_leaf=rows_per_leaf)
    encode = plain()
    by_doc = defaultdict(list)
    for r in out.collect():
        by_doc[r["doc_id"]].append(r)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    for r in sample.collect():
        ids = [*encode(r["text"]), 0]
        parts = sorted(by_doc[r["doc_id"]], key=lambda p: p["piece"])
        assert [i for p in parts for i in p["ids"]] == ids
        assert [p["start"] for p in parts] == [s for s, _ in packing.cuts(len(ids), 2048)]
    used, least = check(out, 2048)
    assert used <= (least + 2 if rows_per_leaf > 7 else 1.1 * least)


def test_tree_merges_as_well_as_one_leaf(spark):
    from seriesmill.llm.common import materialize

    rng = random.Random(3)
    rows = [(i, 0, 0, rng.randint(1, 2048), i) for i in range(3000)]
    pieces = materialize(spark.createDataFrame(rows, packing.PIECE_SCHEMA), "pieces")
    one = check(packing.pack(pieces, rows_per_leaf=10**6), 2048)
    many = check(packing.pack(pieces, rows_per_leaf=100, fan_in=3), 2048)
    assert one[1] == many[1] and many[0] <= one[0] * 1.05
    same = materialize(spark.createDataFrame([(1, 0, 0, 1100, 5)] * 500, packing.PIECE_SCHEMA), "pieces")
    assert check(packing.pack(same, rows_per_leaf=50), 2048)[0] == 500


def test_awkward_rows(awkward, empty):
    out = packing.pack_documents(awkward, PATH)
    assert out.where("piece = 0").count() == awkward.count()
    assert out.where("doc_id <= 2").agg(F.max("length")).first()[0] == 1
    check(out, 2048)
    assert packing.pack_documents(empty, PATH).count() == 0


def test_clashing_names(spark):
    from seriesmill.llm.common import materialize

    names = ["bin", "offset", "fill", "up", "node", "target", "sequence_id", "_pack_bin", "_own0", "a b"]
    rows = materialize(spark.range(60).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), (F.col("id") * 31 % 900 + 1).alias("length"), F.lit(1).alias("ids_crc32"), *[F.concat(F.lit(n), F.col("id")).alias(n) for n in names]), "pieces")
    out = packing.pack(rows, rows_per_leaf=7, fan_in=3)
    assert sorted(out.columns) == sorted(rows.columns)
    for r in out.collect():
        assert all(r[n] == f"{n}{r['doc_id']}" for n in names if n not in ("offset", "sequence_id"))
    check(out, 2048)
    with pytest.raises(ValueError):
        packing.pack(rows.drop("length"))
