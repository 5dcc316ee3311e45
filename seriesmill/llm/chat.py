"""Chat formatting with offset-aligned loss masks.

A turn is rendered as `<|role|>`, a start mark, its text, an end mark and a newline. The marks are control characters that no
merge of a byte-level vocabulary touches, so tokens never straddle them. Control strings inside roles and texts are escaped
reversibly. A conversation is rendered whole and encoded once; token spans come from the tokens' byte lengths, and the
spans of assistant texts, which are sorted, are intersected with them by binary search.

A conversation longer than a bound is rendered and encoded in parts that end with a turn. After a turn's newline comes `<`,
and there the splitting pattern always parts tokens, so the parts' tokens are those of the whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_workers
from .packing import encoder

START, END = "\x02", "\x03"
#: Control strings of this template and of other ones.
CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[SYSTEM_PROMPT]", "[/SYSTEM_PROMPT]", "<start_of_turn>", "<end_of_turn>", "<bos>", "<eos>")
_ESCAPED = re.compile("|".join(re.escape(x) for x in ("\\", START, END, *sorted(CONTROLS, key=len, reverse=True))))
_SINGLE = {"\\": "\\\\", START: "\\2", END: "\\3"}
_CODED = re.compile(r"\\([\\23-])")
_PLAIN = {"\\": "\\", "2": START, "3": END, "-": ""}
_TURN = re.compile(f"<\\|(.*?)\\|>{START}(.*?){END}\n", re.S)
PART_SCHEMA = "conv_id long, part int, text string, ids array<int>, loss array<boolean>"
DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"


def escape(text: str) -> str:
    """text with no control string in it; unescape gives it back."""
    return _ESCAPED.sub(lambda m: _SINGLE.get(m[0]) or "".join(c + "\\-" for c in m[0]), text)


def unescape(text: str) -> str:
    return _CODED.sub(lambda m: _PLAIN[m[1]], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text of (role, text) turns, and the byte spans of assistant texts in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<|{escape(role)}|>{START}", escape(text)
        start = at + len(head.encode())
        stop = start + len(body.encode())
        if role == "assistant":
            spans.append((start, stop))
        out.append(f"{head}{body}{END}\n")
        at = stop + 2
    return "".join(out), spans


def turns_of(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns that render wrote."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(text)]


def loss_mask(ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens lie in one of the sorted spans; ends: the tokens' ends, in bytes."""
    mask = np.zeros(len(ends), bool)
    if spans:
        s = np.array(spans)
        first, last = np.searchsorted(ends, s[:, 0], "right"), np.searchsorted(ends, s[:, 1], "right")
        for a, b in zip(first, last, strict=True):
            mask[a:b] = True
    return mask


class Vocabulary:
    """Encodes with a tokenizer file and knows each token's bytes."""

    def __init__(self, path: str):
        import json

        from .packing import _byte_alphabet

        alphabet = _byte_alphabet()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        self.encode = encoder(path, True)
        self.tokens = {i: t.encode() if t in special else bytes(alphabet[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        size = max(self.tokens) + 1
        self.length = np.array([len(self.tokens.get(i, b"")) for i in range(size)], np.int64)

    def ends(self, ids: np.ndarray) -> np.ndarray:
        return np.cumsum(self.length[ids])


_known: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _known:
        _known[path] = Vocabulary(path)
    return _known[path]


def _formatted(path: str, part_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        rows: list[tuple] = []
        turns: list[tuple[str, str]] = []
        now, part, chars, begun = None, 0, 0, False

        def flush() -> None:
            text, spans = render(turns)
            ids = np.array(vocab.encode(text), np.int64)
            rows.append((now, part, text, ids.astype(np.int32), loss_mask(vocab.ends(ids), spans)))

        def table() -> pa.RecordBatch:
            kinds = pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "part", "text", "ids", "loss"])

        for b in batches:
            for conv, role, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if begun and (conv != now or chars > part_chars):
                    flush()
                    part = part + 1 if conv == now else 0
                    turns, chars = [], 0
                now, begun = conv, True
                turns.append((role or "", text or ""))
                chars += len(text or "") + len(role or "")
            if rows:
                yield table()
                rows.clear()
        if begun:
            flush()
            yield table()

    return run


def format_conversations(rows: DataFrame, tokenizer_path: str, part_chars: int = 1 << 20) -> DataFrame:
    """PART_SCHEMA from (conv_id, turn, role, text): each conversation's text, ids and loss mask, in one part unless it is very long.

    Turns are ordered by turn (nulls first), then role and text. Null roles and texts count as empty; null conversation ids
    are one conversation. A partition is read turn by turn, so no conversation is held whole. Parts of one conversation
    stay together and in order. An empty table gives an empty result; other columns are ignored.
    """
    python_workers(rows.sparkSession)
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    dealt = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_formatted(tokenizer_path, part_chars), PART_SCHEMA)


def _digested(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        state: dict | None = None

        def row(s: dict) -> tuple:
            return s["conv"], s["n"], s["turns"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(), s["chars"], s["tokens"], s["masked"]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            kinds = pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()
            names = [x.split()[0] for x in DIGEST_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for b in batches:
            rows = []
            for conv, part, text, ids, loss in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if part == 0:
                    if state:
                        rows.append(row(state))
                    state = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "tokens": 0, "masked": 0}
                for role, said in turns_of(text):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{said}\n".encode())
                learned = unescape(b"".join(vocab.tokens[i] for i, m in zip(ids, loss, strict=True) if m).decode())
                state["loss"].update(learned.encode())
                state["loss_chars"] += len(learned)
                state["chars"] += len(text)
                state["tokens"] += len(ids)
                state["masked"] += sum(loss)
            if rows:
                yield table(rows)
        if state:
            yield table([row(state)])

    return run


def digests(parts: DataFrame, tokenizer_path: str) -> DataFrame:
    """DIGEST_SCHEMA: what can be read back from format_conversations, a row per conversation."""
    return parts.mapInArrow(_digested(tokenizer_path), DIGEST_SCHEMA)
