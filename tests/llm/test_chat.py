"""Chat formatting: an exact round trip, masks, parts."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seriesmill.llm import chat

PATH = public_tokenizers.path("byte_bpe_50k.json")
NOISE = st.text(st.one_of(st.sampled_from("\\-23\x02\x03<|>/[]INSTs \n"), st.characters(codec="utf-8")), max_size=40)


@settings(max_examples=300, deadline=None)
@given(NOISE)
def test_escape_is_reversible_and_leaves_no_control_string(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text
    assert not any(c in out for c in (*chat.CONTROLS, chat.START, chat.END))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.just("assistant"), NOISE), NOISE), max_size=5))
def test_round_trip_and_mask(turns):
    text, spans = chat.render(turns)
    assert chat.turns_of(text) == turns
    vocab = chat.vocabulary(PATH)
    ids = np.array(vocab.encode(text), int)
    ends = vocab.ends(ids)
    assert (ends[-1] if len(ends) else 0) == len(text.encode())
    mask = chat.loss_mask(ends, spans)
    learned = b"".join(vocab.tokens[i] for i in ids[mask]).decode()
    assert chat.unescape(learned) == "".join(t for r, t in turns if r == "assistant")


def test_offsets_are_the_tokenizers(sample):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    vocab = chat.vocabulary(PATH)
    for r in sample.limit(20).collect():
        e = t.encode(r["text"], add_special_tokens=False)
        raw = r["text"].encode()
        ends = vocab.ends(np.array(e.ids))
        for (a, b), end in zip(e.offsets, ends, strict=True):
            assert len(r["text"][:b].encode()) >= end > len(r["text"][:a].encode()) - 4
        assert b"".join(vocab.tokens[i] for i in e.ids) == raw


def brute(rows):
    convs = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        convs.setdefault(conv, []).append((role or "", text or ""))
    out = []
    for conv, turns in convs.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(chat.render(turns)[0])))
    return sorted(out, key=str)


@pytest.mark.parametrize("part_chars", [1 << 20, 200])
def test_conversations(spark, part_chars):
    rng = random.Random(0)
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (None, 0, None, None), (None, 0, "assistant", ""), (9001, None, "assistant", " \n x \x02\x03"), (9001, 1, "as|>", "q"), (9001, 1, "as|>", "q")]
    rows += [(9002, i, "assistant" if i % 2 else "user", "".join(rng.choice("ab \n<|>") for _ in range(50))) for i in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS part", "2 AS ids")
    parts = chat.format_conversations(df, PATH, part_chars)
    got = sorted((tuple(r)[:6] for r in chat.digests(parts, PATH).collect()), key=str)
    assert got == brute(rows)
    if part_chars == 200:
        whole = {r["conv_id"]: r["ids"] for r in chat.format_conversations(df, PATH).collect()}
        joined = {}
        for r in sorted(parts.collect(), key=lambda r: (str(r["conv_id"]), r["part"])):
            joined.setdefault(r["conv_id"], []).extend(r["ids"])
        assert joined == whole


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_conversations(df, PATH), PATH).count() == 0
