"""Best-fit packing with a local search that exchanges documents.

Sequences begin as best fit leaves them, longest documents first. Then, as long as fewer sequences could hold all, the emptiest one gives
documents away: a document moves to another underfull sequence, is exchanged for a shorter one, two go for one, or one for two
whose lengths together are less. Every step takes tokens from a sequence and puts them into a fuller one, so the sum of squared fills rises and the
search ends; a sequence that has given all is gone.

How it scales. A text is cut before white space and where letters, digits and other signs meet, where no token of a byte-level vocabulary can
reach across, and a worker asks the tokenizer once for each distinct chunk that it remembers. Only (document, piece, start, length, checksum) is shuffled. Pieces that fill a window need
no search; the others are dealt to shards of about SHARD by a hash of their row, whatever their ids, and each shard is
packed alone. Its emptiest sequence goes on to the next round, with those of all other shards, until one shard is left or a round no longer halves what goes on. A sequence has at most 63
lengths that differ, so the search looks at lengths and their sums, not at pairs of documents; EFFORT bounds its looks in a shard and
thus its time, never what is packed.

Cases. Null text counts as empty, null ids stay null; an empty text has one id, the end mark. Rows that share an id are packed each
on its own. Texts of more than a window are cut into full windows behind a first piece that may be shorter, others stay whole. An empty table gives no
rows; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._arrays import flat, hashes
from ._lean import lean
from ._spark import parts_for, stash, table, texts, with_nulls
from ._words import blocks, seams
from .packing import best_fit, tokenizer

WINDOW, END = 2048, 0
#: Pieces packed together, and looks at a sequence in one shard.
SHARD, EFFORT = 20_000, 1000

GAP, SOLID = np.zeros(256, bool), np.zeros(256, bool)
GAP[[9, 10, 13, 32]] = True
SOLID[0x21:0x7F] = True


def chunks(at: np.ndarray, data: np.ndarray, whole: list[bytes] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of pieces that byte-level vocabularies encode alike alone and in place: cut at seams, or, without ``whole``, before white space that follows a visible ASCII sign."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    cut = np.append(False, GAP[data[1:]] & SOLID[data[:-1]]) if whole is None else seams(data, whole)
    cut[at[:-1][at[:-1] < len(data)]] = True
    start = np.flatnonzero(cut)
    return start, np.append(start[1:], len(data)), np.searchsorted(at, start, "right") - 1


def token_ids(path: str, at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids per row) of flat texts."""
    model, memo, whole = tokenizer(path)

    def encode(parts: list[bytes], _: np.ndarray) -> list[list[int]]:
        return [e.ids for e in model.encode_batch_fast([p.decode() for p in parts], add_special_tokens=False)]

    start, end, row = chunks(at, data, whole)
    if not len(start):
        return np.zeros(0, np.int32), np.zeros(len(at) - 1, np.int64)
    ids, per = memo.encode(hashes(data, start, end), start, end, data, encode)
    return ids, np.bincount(row, per, minlength=len(at) - 1).astype(np.int64)


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


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
                    edges = [a, *range(b - (b - a - 1) // window * window, b + 1, window)]
                    for k, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                        out.append((doc, k, s - a, e - s, zlib.crc32(raw[4 * s : 4 * e])))
                cols = [pa.array(np.array(c, np.int64)) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([cols[0], cols[1].cast(pa.int32()), *cols[2:]], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return go


class Bins:
    """Sequences of a shard under exchange: for each, its documents by length."""

    def __init__(self, lengths: np.ndarray, seq: np.ndarray, window: int) -> None:
        self.window, self.lengths = window, lengths
        self.fill = np.bincount(seq, lengths).astype(np.int64)
        self.own: list[dict[int, list[int]]] = [{} for _ in self.fill]
        for i, (n, s) in enumerate(zip(lengths.tolist(), seq.tolist(), strict=True)):
            self.own[s].setdefault(n, []).append(i)
        self.sums: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.least = -(-int(lengths.sum()) // window)  # sequences that must remain

    def offers(self, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sum, one length, the other or 0) of what a sequence can give at once: one document or two."""
        if b not in self.sums:
            n = np.array(sorted(self.own[b]), np.int64)
            i, j = np.triu_indices(len(n), 1)
            twice = np.array([x for x in n.tolist() if len(self.own[b][x]) > 1], np.int64)
            x, y = np.concatenate([n, n[i], twice]), np.concatenate([np.zeros(len(n), np.int64), n[j], twice])
            self.sums[b] = x + y, x, y
        return self.sums[b]

    def search(self, effort: int) -> None:
        """Exchanges until the least number of sequences is left, no exchange helps, or effort is spent."""
        tried = 0
        while (self.fill > 0).sum() > self.least and tried < effort:
            under = np.flatnonzero((self.fill > 0) & (self.fill < self.window))
            for source in under[np.argsort(self.fill[under], kind="stable")].tolist():
                tried += 1
                if self.give(source, under[under != source]):
                    break
                if tried >= effort:
                    return
            else:
                return

    def give(self, source: int, others: np.ndarray) -> bool:
        """The exchange that takes most tokens from source to another that is no emptier; of those that can take them, the tightest."""
        others = others[self.fill[others] >= self.fill[source]]
        if not len(others):
            return False
        back = [self.offers(b) for b in others.tolist()]
        size = np.array([len(x[0]) for x in back])
        owner = np.concatenate([others, np.repeat(others, size)])  # nothing comes back, or what it offers
        total, x, y = (np.concatenate([np.zeros(len(others), np.int64), *c]) for c in zip(*back, strict=True))
        room = self.window - self.fill[owner]
        most = np.full(self.window + 1, -1)
        np.maximum.at(most, total, room)  # the largest room of a sequence that can give so much back
        single = np.full(self.window + 1, -1)
        np.maximum.at(single, total[y == 0], room[y == 0])
        out, a, b = self.offers(source)
        back_of = np.arange(self.window + 1)
        gain = out[:, None] - back_of[None, :]
        gain = np.where((gain > 0) & (gain <= np.where((b > 0)[:, None], single[None, :], most[None, :])), gain, 0)  # two go for one, not for two
        i, back_sum = divmod(int(gain.argmax()), self.window + 1)
        gain = int(gain[i, back_sum])
        if not gain:
            return False
        fit = np.flatnonzero((total == back_sum) & (room >= gain) & ((y == 0) | (b[i] == 0)))
        k = fit[room[fit].argmin()]
        self._hand(source, int(owner[k]), [int(a[i]), int(b[i])])
        self._hand(int(owner[k]), source, [int(x[k]), int(y[k])])
        return True

    def _hand(self, a: int, b: int, lengths: list[int]) -> None:
        for n in lengths:
            if n:
                item = self.own[a][n].pop()
                if not self.own[a][n]:
                    del self.own[a][n]
                self.own[b].setdefault(n, []).append(item)
                self.fill[a] -= n
                self.fill[b] += n
        self.sums.pop(a, None)
        self.sums.pop(b, None)

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of each document, sequences numbered without gaps."""
        seq, offset, k = np.zeros(len(self.lengths), np.int64), np.zeros(len(self.lengths), np.int64), 0
        for own in self.own:
            at = 0
            for n in sorted(own, reverse=True):
                for i in own[n]:
                    seq[i], offset[i] = k, at
                    at += n
            k += bool(own)
        return seq, offset


def search(lengths: np.ndarray, window: int, effort: int = EFFORT) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of documents of these lengths, longest first."""
    seq, _ = best_fit(lengths, window)
    bins = Bins(lengths, seq, window)
    bins.search(effort)
    return bins.places()


def _pack(window: int, level: int, last: bool):
    def go(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = t.column("length").to_numpy()
        seq, offset = search(lengths, window)
        fill = np.bincount(seq, lengths)
        loose = np.zeros(len(t), bool) if last or fill.min() == window else seq == fill.argmin()
        shard = t.column("shard").to_numpy()
        t = t.drop_columns(["shard"])
        return t.append_column("sequence_id", pa.array((level << 56) + (shard << 32) + seq)).append_column("offset", pa.array(offset)).append_column("loose", pa.array(loose))

    return go


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end: int = END) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    if window < 1:
        raise ValueError("a window holds at least one id")
    pieces = stash(texts(docs, id_col, text_col).mapInArrow(lean(_pieces(path, window, end), "tokenizers"), PIECE), "pieces")
    number = F.monotonically_increasing_id()
    out = pieces.where(F.col("length") == window).select("*", (-1 - number).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, level, last = pieces.where(F.col("length") < window), 0, False
    n = rest.count()
    while not last:
        shards = parts_for(n, SHARD)
        last = shards == 1 or level > 0 and 2 * n > before  # too little would come together in another round
        dealt = rest.withColumn("shard", F.pmod(F.xxhash64(number), F.lit(shards)))
        packed = stash(dealt.groupBy("shard").applyInArrow(_pack(window, level, last), f"{PIECE}, sequence_id long, offset long, loose boolean"), "packed")
        out = out.unionByName(packed.where("not loose").drop("loose"))
        rest, level, before = packed.where("loose").drop("loose", "sequence_id", "offset"), level + 1, n
        n = 0 if last else rest.count()
    return with_nulls(out)


def op12_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens, as few as the search leaves."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op12_swap_packing": op12_swap_packing}
SQL: dict[str, str] = {}
