"""Packing documents into sequences by best-fit decreasing.

How it scales. A text is cut at white space and where letters, digits and other signs meet, and a worker asks the tokenizer once for each
distinct chunk it meets (no token spans such a place, so this is what the whole text gives; a tokenizer that splits otherwise is asked by words). A document's ids are cut into full
windows and a rest at once, so only (document, start, length, checksum) is shuffled. Pieces are dealt
by a hash of their row, whatever their ids, into shards of about SHARD pieces; each shard packs alone. Its last few windows are the only ones
badly filled, which at this size is far below one part in a hundred.

Cases. Null text counts as empty, null ids stay null; an empty text has one id, the end mark. Rows that share an id are packed
each on its own. Ties go by (length, doc_id, start). An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._arrays import flat, hashes
from ._lean import kept, lean, lean_group
from ._memo import Memo
from ._spark import parts_for, stash, table, texts, with_nulls
from ._words import SPACE, blocks, seams, words

WINDOW, END = 2048, 1
#: Pieces packed together.
SHARD = 40_000

_tokenizers: dict[str, tuple] = kept("tokenizers")


def tokenizer(path: str) -> tuple:
    """The tokenizer of a file and this worker's memo for it."""
    if path not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path), Memo(), by_kind(path)
    return _tokenizers[path]


#: Splits that keep letters, digits and other signs apart.
APART = [
    [{"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}],
    [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
]
#: What may come before, as it neither joins nor parts what stands at a seam.
BEFORE = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


def by_kind(path: str) -> list[bytes] | None:
    """For a tokenizer that splits as ``seams`` does: the texts that it takes whole. None for any other."""
    import json

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    parts, clean, whole = model["pre_tokenizer"] or {}, model["normalizer"] or {"normalizers": []}, model["added_tokens"]
    known = parts.get("pretokenizers", [parts]) in APART and all(c in BEFORE for c in clean.get("normalizers", [clean])) and not any(t["normalized"] for t in whole)
    return [t["content"].encode() for t in whole] if known else None


def token_ids(path: str, at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids per row) of flat texts."""
    model, memo, whole = tokenizer(path)

    def encode(chunks: list[bytes], _: np.ndarray) -> list[list[int]]:
        return [e.ids for e in model.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)]

    start, end, row = words(at, data)
    if not len(start):
        return np.zeros(0, np.int32), np.zeros(len(at) - 1, np.int64)
    if whole is not None:
        inner = seams(data, whole) & ~SPACE[data]
        inner[start] = False
        inner = np.flatnonzero(inner)
        start, end = np.sort(np.append(start, inner)), np.sort(np.append(end, inner))
        row = np.searchsorted(at, start, "right") - 1
    ids, per = memo.encode(hashes(data, start, end), start, end, data, encode)
    return ids, np.bincount(row, per, minlength=len(at) - 1).astype(np.int64)


def _pieces(path: str, window: int, end: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = flat(batch.column("text"))
            docs = batch.column("doc_id").to_numpy()
            for i, j, offsets, part in blocks(at, data):
                ids, n = token_ids(path, offsets, part)
                own = np.insert(ids, np.cumsum(n), end).astype("<u4")
                stop = np.cumsum(n + 1)
                raw = memoryview(own).cast("B")
                out = []
                for doc, a, b in zip(docs[i:j].tolist(), (stop - n - 1).tolist(), stop.tolist(), strict=True):
                    for s in range(a, b, window):
                        e = min(s + window, b)
                        out.append((doc, s - a, e - s, zlib.crc32(raw[4 * s : 4 * e]), b - a))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in zip(*out, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return go


class OpenWindows:
    """Open windows by remaining capacity: a segment tree tells the least capacity in use from a size on."""

    def __init__(self, window: int) -> None:
        self.leaves = 1 << (window + 1).bit_length()
        self.used = [False] * (2 * self.leaves)
        self.by: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, window: int) -> None:
        self.by[capacity].append(window)
        k = self.leaves + capacity
        while k and not self.used[k]:
            self.used[k] = True
            k >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(capacity, window) of the tightest window that holds ``size``, removed from the tree."""
        used, k = self.used, self.leaves + size
        if not used[k]:
            while not (k & 1 == 0 and used[k + 1]):  # up until there is something to the right
                k >>= 1
                if k <= 1:
                    return None
            k += 1
            while k < self.leaves:
                k *= 2
                k += not used[k]
        capacity = k - self.leaves
        window = self.by[capacity].pop()
        if not self.by[capacity]:
            used[k] = False
            k >>= 1
            while k and not (used[2 * k] or used[2 * k + 1]):
                used[k] = False
                k >>= 1
        return capacity, window


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, pieces given longest first."""
    open_, n = OpenWindows(window), 0
    seq, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, size in enumerate(lengths.tolist()):
        found = open_.take(size)
        if found is None:
            capacity, where = window, n
            n += 1
        else:
            capacity, where = found
        seq[i], offset[i] = where, window - capacity
        if capacity > size:
            open_.put(capacity - size, where)
    return seq, offset


def _pack(window: int):
    def go(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        seq, offset = best_fit(t.column("length").to_numpy(), window)
        shard = t.column("shard").to_numpy()
        t = t.drop_columns(["shard"])
        return t.append_column("sequence_id", pa.array((shard << 32) + seq)).append_column("offset", pa.array(offset))

    return go


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if window < 1:
        raise ValueError("a window holds at least one id")
    pieces = stash(texts(docs, id_col, text_col).mapInArrow(lean(_pieces(path, window, end), "tokenizers"), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"), "pieces")
    shards = parts_for(pieces.count(), SHARD)
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    return with_nulls(pieces.groupBy("shard").applyInArrow(lean_group(_pack(window)), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op9_packing": op9_packing}
SQL: dict[str, str] = {}
