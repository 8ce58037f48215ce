"""Byte-level BPE: encoding and decoding with given ranks.

Two tiers. A minimal perfect hash over the vocabulary resolves every pre-token that is itself a token; the
others are merged with a heap of ranked pairs over linked bytes. A worker remembers merged pre-tokens up to
a fixed number.

How it scales. Each row is encoded alone: one pass, no shuffle. Pre-tokens are found by character
classes over whole blocks of text, and each distinct one is looked up once a block. The hash table is as
large as the vocabulary, is built once by the driver and travels with the task.

Cases. Null ids stay null; null text counts as empty and has no tokens. Special tokens are ordinary text. Repeated rows and
ids stay, each on its own. An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._arrays import U, flat, groups, hashes, mix
from ._memo import Memo
from ._spark import table, texts, with_nulls

#: Unicode's White_Space.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER, LETTER, NUMBER, SPACE = range(4)

_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of every code point."""
    if not _classes:
        import regex

        out = np.zeros(0x110000, np.uint8)
        every = np.setdiff1d(np.arange(0x110000), np.arange(0xD800, 0xE000)).astype("<u4")
        text = every.tobytes().decode("utf-32-le")
        for kind, name in ((LETTER, "L"), (NUMBER, "N")):
            for m in regex.finditer(rf"\p{{{name}}}+", text):
                out[every[m.start() : m.end()]] = kind
        out[WHITE] = SPACE
        _classes.append(out)
    return _classes[0]


def pre_tokens(at: np.ndarray, data: np.ndarray) -> np.ndarray:
    """First byte of each pre-token of flat texts, in order; each ends where the next begins.

    The rules of the public pattern: contractions in lower case; an optional blank before letters, numbers or
    other signs; white space before more text leaves its last character to what follows.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    byte = np.flatnonzero((data & 0xC0) != 0x80)
    cp = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    n = len(cp)
    kind = classes()[cp]
    begins = np.zeros(n + 1, bool)  # where a text begins or ends
    begins[np.searchsorted(byte, at)] = True
    first = np.append(True, kind[1:] != kind[:-1]) | begins[:-1]
    start = first.copy()
    i = np.flatnonzero(first & ~begins[:-1] & (kind != SPACE))
    i = i[kind[i - 1] == SPACE]
    start[i - 1] = True  # the last of white space before text stands alone or
    start[i[cp[i - 1] == 0x20]] = False  # goes with the text
    # Contractions: a single apostrophe that nothing precedes in its pre-token, then letters of the same text.
    i = np.flatnonzero(start & (cp == 0x27))
    i = i[i + 1 < n]
    i = i[(kind[i + 1] == LETTER) & ~begins[i + 1]]
    a = cp[i + 1]
    b = np.where((i + 2 < n) & ~begins[np.minimum(i + 2, n)], cp[np.minimum(i + 2, n - 1)], 0)
    size = np.where(np.isin(a, [ord(c) for c in "stmd"]), 1, 0)
    for x, y in ("re", "ve", "ll"):
        size[(a == ord(x)) & (b == ord(y))] = 2
    i, size = i[size > 0], size[size > 0]
    start[i + 1] = False
    nxt = i + 1 + size
    start[nxt[nxt < n]] = True
    return byte[start]


class PerfectHash:
    """A minimal perfect hash by hash and displace: a bucket of several keys gets the first seed that sends them to free slots; single ones take what is left."""

    def __init__(self, keys: np.ndarray) -> None:
        n = len(keys)
        self.size, self.buckets = n, max(1, n // 4)
        bucket = (keys % U(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        self.seed = np.zeros(self.buckets, np.int64)
        self.slot_key = np.zeros(n, U)
        taken = np.zeros(n, bool)
        for b in np.argsort(-np.diff(edges), kind="stable").tolist():
            own = keys[order[edges[b] : edges[b + 1]]]
            if len(own) < 2:
                break
            seed = 1
            while True:
                slots = self._slots(own[None, :], np.arange(seed, seed + 32)[:, None])
                free = ~taken[slots].any(1)
                for k in np.flatnonzero(free):
                    if len(set(slots[k].tolist())) == len(own):
                        break
                else:
                    seed += 32
                    continue
                self.seed[b] = seed + k
                taken[slots[k]] = True
                self.slot_key[slots[k]] = own
                break
        rest = np.flatnonzero(np.diff(edges) == 1)
        free = np.flatnonzero(~taken)
        self.seed[rest] = -1 - free[: len(rest)]
        self.slot_key[free[: len(rest)]] = keys[order[edges[rest]]]

    def _slots(self, keys: np.ndarray, seed: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(keys ^ (seed.astype(U) * U(0xE7037ED1A0B428DB))) % U(self.size)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for what is not in the table."""
        seed = self.seed[(keys % U(self.buckets)).astype(np.int64)]
        slot = np.where(seed < 0, -1 - seed, self._slots(keys, np.maximum(seed, 0)))
        return np.where(self.slot_key[slot] == keys, slot, -1)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token that is no token: the pair of least rank, the leftmost of them, merges first."""
    n = len(piece)
    end, nxt, prev = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = nxt[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue  # one side has merged since
        alive[j] = False
        end[i], nxt[i] = stop, nxt[j]
        if nxt[j] < n:
            prev[nxt[j]] = i
            if (r := ranks.get(piece[i : end[nxt[j]]])) is not None:
                heapq.heappush(heap, (r, i, end[nxt[j]]))
        if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Encoder:
    """A vocabulary, ready to encode flat texts and to decode ids."""

    def __init__(self, tokens: list[bytes], ids: list[int]) -> None:
        self.tokens, self.ids = tokens, ids
        self.ranks = dict(zip(tokens, ids, strict=True))
        self.by_id = [b""] * (max(ids, default=-1) + 1)
        for t, i in self.ranks.items():
            self.by_id[i] = t
        at = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)
        keys = hashes(np.frombuffer(b"".join(tokens), np.uint8), at[:-1], at[1:])
        self.table = PerfectHash(keys)
        self.slot_id = np.zeros(len(keys), np.int64)
        self.slot_id[self.table.find(keys)] = ids
        self.memo = Memo()
        self.digits: list[str] = [str(i) for i in range(len(self.by_id))]

    @staticmethod
    def read(path: str) -> Encoder:
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        return Encoder([base64.b64decode(a) for a, _ in pairs], [int(b) for _, b in pairs])

    def _encode(self, pieces: list[bytes], keys: np.ndarray) -> list[list[int]]:
        slots = self.table.find(keys)
        ids = np.where(slots >= 0, self.slot_id[slots], -1).tolist()
        return [[i] if i >= 0 and self.by_id[i] == p else merge(p, self.ranks) for p, i in zip(pieces, ids, strict=True)]

    def encode(self, at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids per row)."""
        start = pre_tokens(at, data)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(at) - 1, np.int64)
        end = np.append(start[1:], len(data))
        ids, per = self.memo.encode(hashes(data, start, end), start, end, data, self._encode)
        return ids, np.bincount(np.searchsorted(at, start, "right") - 1, per, minlength=len(at) - 1).astype(np.int64)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.by_id[i] for i in ids])


_encoders: dict[str, Encoder] = {}


def _digests(path: str, encoder):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoders.setdefault(path, encoder.value)
        for batch in batches:
            at, data = flat(batch.column("text"))
            docs = batch.column("doc_id").to_numpy()
            for i, j in groups(at, 1 << 20):
                ids, n = own.encode(at[i : j + 1] - at[i], data[at[i] : at[j]])
                ids, stop = ids.tolist(), np.cumsum(n).tolist()
                ids_sha, text_sha, a = [], [], 0
                for b in stop:
                    doc = ids[a:b]
                    ids_sha.append(hashlib.sha256(" ".join([own.digits[x] for x in doc]).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(own.decode(doc)).hexdigest())
                    a = b
                yield pa.RecordBatch.from_arrays([pa.array(docs[i:j]), pa.array(n), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return go


def _ids(path: str, encoder):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoders.setdefault(path, encoder.value)
        for batch in batches:
            at, data = flat(batch.column("text"))
            for i, j in groups(at, 1 << 20):
                ids, n = own.encode(at[i : j + 1] - at[i], data[at[i] : at[j]])
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], ["doc_id", "ids"])

    return go


def _texts(path: str, encoder):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoders.setdefault(path, encoder.value)
        for batch in batches:
            raw = [own.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "bytes"])

    return go


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>)."""
    encoder = docs.sparkSession.sparkContext.broadcast(Encoder.read(path))
    return with_nulls(texts(docs, id_col, text_col).mapInArrow(_ids(path, encoder), "doc_id long, ids array<int>"))


def decode(ids: DataFrame, path: str) -> DataFrame:
    """(doc_id, bytes) of (doc_id, ids); null ids give no bytes."""
    encoder = ids.sparkSession.sparkContext.broadcast(Encoder.read(path))
    return ids.select("doc_id", "ids").mapInArrow(_texts(path, encoder), "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    encoder = docs.sparkSession.sparkContext.broadcast(Encoder.read(path))
    return with_nulls(texts(docs, id_col, text_col).mapInArrow(_digests(path, encoder), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of every document."""
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


QUERIES = {"op7_byte_bpe": op7_byte_bpe}
# Decoding byte-level BPE gives the text's own bytes back, which SQL can say; the ids are tested against another encoder.
SQL: dict[str, str] = {}
