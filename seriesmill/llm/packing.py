"""Best-fit packing of tokenised documents: leaves pack best-fit, nearly full bins leave, underfull ones merge up a tree.

Leaf bins are filled by best-fit decreasing. What is underfull becomes an item itself, of its fill, and is packed best-fit
again with the items of the neighbouring leaves, level by level. After a best-fit-decreasing round a leaf holds at most one
bin that is half full or less (two would have been merged), and a bin over half full can only take one of those. So of the
bins with one residual never more can be of use than there are nodes; the others leave at once, at no loss, and what climbs
the tree stays bounded by the number of leaves.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, python_workers

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Fixed value: the pattern by which byte-level BPE of this vocabulary splits texts before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself if printable, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(maxsize=2)
def encoder(path: str, plain_specials: bool = False):
    """texts -> lists of ids as `tokenizers` gives them for the file at path without adding special tokens.

    Strings of special tokens within a text get those tokens' ids, as there; with plain_specials they are ordinary text.
    For byte-level BPE whose ids are the order of its merges, tiktoken gives the same ids several times faster; other
    files, texts with such strings, and texts that it can't take go through tokenizers.
    """
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = plain_specials
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    vocab, alphabet = model.get("vocab", {}), _byte_alphabet()
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model.get("merges", [])]
    special = {t["content"] for t in spec.get("added_tokens", [])}
    met = re.compile("|".join(re.escape(t) for t in sorted(special))) if special and not plain_specials else None
    ordered = all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(pairs))
    quick = None
    if model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer") and ordered and not model.get("ignore_merges"):
        import tiktoken

        ranks = {bytes(alphabet[c] for c in token): i for token, i in vocab.items() if token not in special}
        if len(ranks) == 256 + len(pairs):
            quick = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if quick is not None and not (met and met.search(text)):
            try:
                return quick.encode_ordinary(text)
            except BaseException as e:  # on texts beyond its limits the library raises an exception that isn't exported
                if type(e).__name__ != "PanicException":
                    raise
        return plain.encode(text, add_special_tokens=False).ids

    return encode


def cuts(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: one if they fit, else full ones after a first one with the rest."""
    if n <= limit:
        return [(0, n)]
    first = n % limit or limit
    return [(0, first), *((at, limit) for at in range(first, n, limit))]


def _tokenized(path: str, limit: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches:
            rows, ids_out = [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                for p, (start, length) in enumerate(cuts(len(ids), limit)):
                    part = ids[start : start + length]
                    rows.append((doc, p, start, length, zlib.crc32(part.tobytes())))
                    if with_ids:
                        ids_out.append(part.astype(np.int32))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(ids_out, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, limit: int = 2048, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's ids and the end id, cut into pieces of at most limit; null texts count as empty (the end id alone)."""
    python_workers(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(_tokenized(tokenizer_path, limit, end_id, with_ids), PIECE_SCHEMA + (", ids array<int>" if with_ids else ""))


def best_fit(sizes: Iterable[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each size, taken in the given order, and the fills: the fullest bin that has room, else a new one."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    bins, offsets, fills = [], [], []
    for s in sizes:
        fitting = rooms >> s
        if s and fitting:
            r = s + (fitting & -fitting).bit_length() - 1
            k = by_room[r].pop()
            if not by_room[r]:
                rooms &= ~(1 << r)
        else:
            k, r = len(fills), capacity
            fills.append(0)
        bins.append(k)
        offsets.append(fills[k])
        fills[k] += s
        if left := r - s:
            by_room[left].append(k)
            rooms |= 1 << left
    return bins, offsets, fills


def useful(fills: np.ndarray, capacity: int, full: float, nodes: int) -> np.ndarray:
    """Which bins go up the tree: not nearly full, and of those over half full no more with one residual than nodes."""
    up = fills < full * capacity
    big = np.flatnonzero(up & (2 * fills > capacity))
    order = big[np.argsort(fills[big], kind="stable")]
    f = fills[order]
    rank = np.arange(len(f)) - np.searchsorted(f, f)
    up[order[rank >= nodes]] = False
    return up


#: Columns that placing adds for itself; a table that has one of these names keeps its own column.
_BIN, _OFFSET, _FILL, _UP, _NODE = "_pack_bin", "_pack_offset", "_pack_fill", "_pack_up", "_pack_node"


def _leaf(capacity: int, full: float, leaves: int):
    """A partition is a leaf: all its pieces are placed; bin ids are unique over leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b for b in batches if b.num_rows]
        if not own:
            return
        t = pa.Table.from_batches(own)
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        k = TaskContext.get().partitionId()
        bins, offsets, fills = (np.array(x, np.int64) for x in best_fit(t["length"].to_pylist(), capacity))
        up = useful(fills, capacity, full, leaves)
        t = t.append_column(_BIN, pa.array((np.int64(k) << 32) + bins)).append_column(_OFFSET, pa.array(offsets))
        t = t.append_column(_FILL, pa.array(fills[bins])).append_column(_UP, pa.array(up[bins]))
        t = t.append_column(_NODE, pa.array(np.full(len(bins), k, np.int64)))
        yield from t.combine_chunks().to_batches(max_chunksize=50_000)

    return run


def _merge(capacity: int, full: float, nodes: int):
    """Bins of one node of the tree, packed again: a bin that joins others moves into the fullest bin of its group."""

    def run(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values(["fill", "bin"], ascending=[False, True], ignore_index=True)
        bins, offsets, fills = best_fit(pdf["fill"].tolist(), capacity)
        head: dict[int, int] = {}
        to = [head.setdefault(k, b) for k, b in zip(bins, pdf["bin"].tolist(), strict=True)]
        fills = np.array(fills, np.int64)
        up = useful(fills, capacity, full, nodes)
        return pd.DataFrame({"bin": pdf["bin"], "target": to, "shift": offsets, "fill": fills[bins], "up": up[bins], "node": key[0]})

    return run


def pack(pieces: DataFrame, capacity: int = 2048, full: float = 0.98, rows_per_leaf: int = 65536, fan_in: int = 8) -> DataFrame:
    """pieces with sequence_id: long and offset: long: sequences of at most capacity, gapless from offset 0.

    pieces must be materialised, with a length from 1 to capacity. Any rows may repeat and ids may be null; an empty table
    gives an empty result. Other columns stay, whatever their names, but for sequence_id and offset, which are replaced.
    Leaves are dealt round-robin, so no key can swell one, and hold about rows_per_leaf rows each.
    """
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    if missing := [n for n in ("length", "doc_id", "piece", "ids_crc32") if n not in columns]:
        raise ValueError(f"pieces have no columns {missing}")
    renamed = {c: f"_own{i}" for i, c in enumerate(columns) if c.startswith(("_pack_", "_own"))}
    rows = pieces.select(*[F.col(f"`{c}`").alias(renamed.get(c, c)) for c in columns])
    back = [F.col(f"`{renamed.get(c, c)}`").alias(c) for c in columns]
    leaves = max(1, -(-pieces.count() // rows_per_leaf))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", {_BIN} long, {_OFFSET} long, {_FILL} long, {_UP} boolean, {_NODE} long"
    placed = materialize(rows.repartition(leaves).mapInArrow(_leaf(capacity, full, leaves), schema), "placed")
    carried = placed.where(f"{_UP} and {_OFFSET} = 0").select(F.col(_BIN).alias("bin"), F.col(_FILL).alias("fill"), F.col(_NODE).alias("node"))
    moves = None
    while leaves > 1:
        leaves = -(-leaves // fan_in)
        up = carried.select("bin", "fill", F.expr(f"node div {fan_in}").alias("node"))
        merged = materialize(up.groupBy("node").applyInPandas(_merge(capacity, full, leaves), "bin long, target long, shift long, fill long, up boolean, node long"), "merged")
        now = merged.where("bin <> target").select("bin", "target", "shift")
        if moves is not None:
            later = now.select(F.col("bin").alias("b"), F.col("target").alias("t"), F.col("shift").alias("s"))
            moves = moves.join(later, moves["target"] == later["b"], "left").select("bin", F.coalesce("t", "target").alias("target"), (F.col("shift") + F.coalesce("s", F.lit(0))).alias("shift")).union(now)
        else:
            moves = now
        carried = merged.where("up and bin = target").select("bin", "fill", "node")
    if moves is None:
        return placed.select(*back, F.col(_BIN).alias("sequence_id"), F.col(_OFFSET).alias("offset"))
    moves = moves.select(F.col("bin").alias("_pack_from"), F.col("target").alias("_pack_to"), F.col("shift").alias("_pack_shift"))
    placed = placed.join(moves, placed[_BIN] == moves["_pack_from"], "left")
    return placed.select(*back, F.coalesce("_pack_to", _BIN).alias("sequence_id"), (F.col(_OFFSET) + F.coalesce("_pack_shift", F.lit(0))).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, limit: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for all pieces of all documents; see token_pieces and pack.

    A null text counts as empty: one piece, the end id. Rows with a null id are packed like others; rows that repeat an id
    are packed each. Other columns are ignored; an empty table gives an empty result.
    """
    return pack(materialize(token_pieces(docs, tokenizer_path, limit, end_id), "pieces"), limit)
