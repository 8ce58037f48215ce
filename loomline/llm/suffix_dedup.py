"""Suffix-array dedup: remove every byte covered by a string of ``length`` bytes that also starts earlier.

How it scales. Every window of ``length`` bytes is known by the least hash among its GRAM-byte grams, so
equal windows always carry the same value; neighbouring windows with one value form a run. Values that
occur once in the corpus cannot hold a repeated window, so only runs of repeated values go on (exact: no
repeated window is ever lost). A bit map of the repeated values, of bounded size, keeps most of the other runs
out of the shuffle. Runs with equal bytes form a class; each member but the first repeats the
first as a whole, so copies are gathered before any text moves. The class leaders are dealt to shards of about SHARD bytes by value. A shard sorts the suffixes of its runs
(Larsson-Sadakane refinement), takes common prefixes (Kasai) and finds windows that start earlier in another
leader. A value whose leaders hold over SPLIT bytes is cut over several shards; these shards also return the
digests of their distinct windows, and for each range of digests the shards' sorted runs are merged by binary search.

Cases. A null id comes after all others; null text counts as empty; a text shorter than ``length`` has no window and stays whole. Rows that
share an id, null or not, are texts of their own, in the order of their texts. An empty table gives an empty result. Only the id
and text columns are read, so names of other columns cannot clash. The order of occurrences is (id, start).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._arrays import U, flat, groups, hashes, heads, prefix_hash, ranges, slice_hash, sliding
from ._lean import lean, lean_group
from ._sieve import Sieve, sieve
from ._spark import drop, numbered, parts_for, stash, table, texts, with_nulls

LENGTH = 100
#: Bytes of a gram. Longer grams repeat less by chance, but leave fewer grams in a window and so more runs.
GRAM = 36
#: Bytes of text worked on at a time.
BLOCK = 1 << 18
#: Bytes of runs in a shard, and in the leaders of one value above which that value is cut over several shards.
SHARD, SPLIT = 1 << 20, 1 << 19


# --- windows by their least gram ------------------------------------------------------------------


def pieces(ids: np.ndarray, at: np.ndarray, data: np.ndarray, length: int) -> Iterator[tuple]:
    """(ids, offsets, bytes, first byte's place in its text): whole texts together, a long one in overlapping cuts."""
    for i, j in groups(at, BLOCK):
        if j - i == 1 and at[j] - at[i] > BLOCK:
            for s in range(0, int(at[j] - at[i]) - length + 1, BLOCK):
                cut = data[at[i] + s : min(at[j], at[i] + s + BLOCK + length - 1)]
                yield ids[i:j], np.array([0, len(cut)]), cut, s
        else:
            yield ids[i:j], at[i : j + 1] - at[i], data[at[i] : at[j]], 0


def runs(at: np.ndarray, data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, start, windows, value, several) of each run of windows that share their least gram.

    several: the gram occurs more than once in the run, so its windows may repeat one another.
    """
    with np.errstate(over="ignore"):
        none = np.zeros(0, np.int64)
        if len(data) < length:
            return none, none, none, none, none.astype(bool)
        p = prefix_hash(data)
        g = slice_hash(p, np.arange(len(data) - gram + 1), np.arange(gram, len(data) + 1)) >> U(16)
        width = length - gram + 1
        m = sliding(np.minimum, g, width)
        counts = np.maximum(np.diff(at) - length + 1, 0)
        ok = ranges(at[:-1], counts)
        if not len(ok):
            return none, none, none, none, none.astype(bool)
        row = np.repeat(np.arange(len(counts)), counts)
        h = heads(m[ok], row)
        start, row = ok[h], row[h]
        n = np.diff(np.append(h, len(ok)))
        value = m[start]
        # A gram stands at the least place of some window if the largest minimum over the windows around it equals it.
        around = sliding(np.maximum, np.concatenate([np.zeros(width - 1, U), m, np.zeros(width - 1, U)]), width)
        least = np.flatnonzero(around == g)
        lo, hi = np.searchsorted(least, start), np.searchsorted(least, start + n + width - 1)
        several = hi - lo > 1
        if several.any():  # other grams may be least in neighbouring runs: count the run's own value only
            k = np.flatnonzero(several)
            own = g[least[ranges(lo[k], (hi - lo)[k])]] == np.repeat(value[k], (hi - lo)[k])
            several[k] = np.add.reduceat(own, np.concatenate([[0], np.cumsum((hi - lo)[k])[:-1]])) > 1
        return row, start, n, value.view(np.int64), several & (n > 1)


def _values(length: int, gram: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = flat(batch.column("text"))
            for _, offsets, cut, _ in pieces(np.arange(len(at) - 1), at, data, length):
                *_, value, several = runs(offsets, cut, length, gram)
                value, n = np.unique(np.concatenate([value, value[several]]), return_counts=True)  # a run that may repeat itself counts twice
                yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n.astype(np.int32))], ["value", "n"])

    return go


def _occurrences(length: int, gram: int, repeated: Sieve | None):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = flat(batch.column("text"))
            ids = batch.column("doc_id").to_numpy()
            for own, offsets, cut, first in pieces(ids, at, data, length):
                found = runs(offsets, cut, length, gram)
                k = np.flatnonzero(repeated.may(found[3])) if repeated else slice(None)
                row, start, n, value, several = (c[k] for c in found)
                if len(row):
                    key = hashes(cut, start, start + n + length - 1)
                    cols = [value, key.view(np.int64), own[row], start - offsets[row] + first, n.astype(np.int32), several]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["value", "key", "doc_id", "start", "n", "several"])

    return go


# --- suffix arrays --------------------------------------------------------------------------------


def suffix_array(b: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Places of ``b`` in the order of their suffixes, by Larsson-Sadakane refinement.

    The first sort goes by seven bytes; each round then doubles the sorted depth and touches only groups that
    are still tied. With ``depth`` it stops as soon as so many bytes are in order.
    """
    n = len(b)
    if n < 2:
        return np.arange(n)
    symbols = np.concatenate([b.astype(U) + U(1), np.zeros(7, U)])
    key = np.zeros(n, U)
    for k in range(7):
        key = (key << U(9)) | symbols[k : n + k]
    sa = np.argsort(key)
    first = heads(key[sa])
    size = np.diff(np.append(first, n))
    rank = np.empty(n, np.int64)
    rank[sa] = np.repeat(first, size)
    tied = ranges(first[size > 1], size[size > 1])
    done = 7
    while len(tied) and (depth is None or done < depth):
        at = sa[tied]
        ahead = at + done
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        group = rank[at]
        order = np.argsort(group * (n + 1) + second)
        at, group, second = at[order], group[order], second[order]
        sa[tied] = at
        first = heads(group, second)
        size = np.diff(np.append(first, len(tied)))
        rank[at] = np.repeat(tied[first], size)
        tied = tied[ranges(first[size > 1], size[size > 1])]
        done *= 2
    return sa


def common_prefixes(b: np.ndarray, sa: np.ndarray, cap: int, lane: int = 256) -> np.ndarray:
    """Length, up to ``cap``, that each suffix shares with the one before it in ``sa``, which is in order for ``cap`` bytes at least.

    Kasai's rule (the next place shares at least one byte less) holds along each lane of ``lane`` places; all
    lanes step together, comparing eight bytes at a time. After ``cap`` equal bytes the order is open, so
    there the next place starts at nothing.
    """
    n = len(b)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate([b, np.zeros(cap + 16, np.uint8)]), 8)
    words = np.ascontiguousarray(words).view(U).ravel()
    out = np.zeros(n, np.int64)
    begin = np.arange(0, n, lane)
    h = np.zeros(len(begin), np.int64)
    for t in range(min(lane, n)):
        p = begin[begin + t < n] + t
        h = np.where(h < cap, np.maximum(h - 1, 0), 0)[: len(p)]
        q = before[p]
        h[q < 0] = 0
        live = np.flatnonzero((q >= 0) & (h < cap))
        while len(live):
            x = words[p[live] + h[live]] ^ words[q[live] + h[live]]
            low = x & (~x + U(1))  # the lowest set bit tells how many bytes agree
            same = np.where(x == 0, 8, (np.bitwise_count(low - U(1)) >> 3)).astype(np.int64)
            room = n - np.maximum(p[live], q[live]) - h[live]  # nothing follows the end
            h[live] += np.minimum(same, room)
            live = live[(same == 8) & (room > 8) & (h[live] < cap)]
        h = np.minimum(h, cap)
        out[p] = h
    return out[sa]


def earlier(b: np.ndarray, window: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(repeats, leaders): which marked places start a string of ``length`` bytes that also starts at an earlier marked place, and which are the first of theirs."""
    sa = suffix_array(b, length)
    lcp = common_prefixes(b, sa, length)
    at = np.flatnonzero(window[sa])
    places = sa[at]
    if not len(at):
        return places, places
    shared = np.minimum.reduceat(lcp[: at[-1] + 1], np.append(0, at[:-1] + 1))  # least prefix from one marked suffix to the next
    first = np.flatnonzero(np.append(True, shared[1:] < length))
    leader = np.minimum.reduceat(places, first)
    repeats = places[places != np.repeat(leader, np.diff(np.append(first, len(places))))]
    return np.sort(repeats), np.sort(leader)


def _shard(length: int):
    def go(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("start", "ascending")])  # a place's number then follows (id, start)
        at, data = flat(t.column("bytes"))
        doc, start, n = (t.column(c).to_numpy() for c in ("doc_id", "start", "n"))
        cut = t.column("cut").to_numpy(zero_copy_only=False)
        window = np.zeros(len(data), bool)
        window[ranges(at[:-1], n)] = True
        repeats, leaders = earlier(data, window, length)
        seg = np.searchsorted(at, repeats, "right") - 1
        h = np.flatnonzero(np.append(True, (repeats[1:] != repeats[:-1] + 1) | (seg[1:] != seg[:-1]))) if len(repeats) else np.zeros(0, np.int64)
        k = seg[h]
        a = start[k] + repeats[h] - at[k]
        b = a + np.diff(np.append(h, len(repeats))) - 1 + length
        lseg = np.searchsorted(at, leaders, "right") - 1
        far = leaders[cut[lseg]]
        lseg = lseg[cut[lseg]]
        raw = data.tobytes()
        digest = [hashlib.blake2b(raw[x : x + length], digest_size=16).digest() for x in far.tolist()]
        z = len(far)
        return pa.table({
            "doc_id": np.concatenate([doc[k], doc[lseg]]), "a": np.concatenate([a, start[lseg] + far - at[lseg]]),
            "b": np.concatenate([b, np.full(z, -1)]), "digest": pa.array([None] * len(a) + digest, pa.binary()),
            "shard": pa.array(np.full(len(a) + z, t.column("shard")[0].as_py(), np.int64)),
        })

    return go


def _find(names: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, found) of digests (hi, lo) in sorted names, by binary search over the first half and steps over its ties."""
    k = np.searchsorted(names[0], hi)
    last = len(names[0]) - 1
    while True:
        on = (k <= last) & (names[0][np.minimum(k, last)] == hi) & (names[1][np.minimum(k, last)] < lo) if last >= 0 else np.zeros(len(k), bool)
        if not on.any():
            break
        k = k + on
    found = (k <= last) & (names[0][np.minimum(k, last)] == hi) & (names[1][np.minimum(k, last)] == lo) if last >= 0 else np.zeros(len(k), bool)
    return k, found


def _merge(length: int):
    def go(t: pa.Table) -> pa.Table:
        """Each shard's windows form a sorted run; one run after another is looked up among the leaders so far, which keep the earliest place of each window."""
        words = np.frombuffer(flat(t.column("digest"))[1].tobytes(), ">u8").astype(U)
        hi, lo = words[::2], words[1::2]
        doc, a, shard = (t.column(c).to_numpy() for c in ("doc_id", "a", "shard"))
        order = np.lexsort((lo, hi, shard))
        hi, lo, doc, a, shard = (c[order] for c in (hi, lo, doc, a, shard))
        names = np.zeros((2, 0), U)
        best = np.zeros((2, 0), np.int64)
        late: list[np.ndarray] = []
        edges = np.append(heads(shard), len(shard))
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            k, found = _find(names, hi[i:j], lo[i:j])
            at = i + np.flatnonzero(found)
            k_at = k[found]
            sooner = (doc[at] < best[0][k_at]) | ((doc[at] == best[0][k_at]) & (a[at] < best[1][k_at]))
            own = np.stack([doc[at], a[at]])
            late.append(np.where(sooner, best[:, k_at], own))
            best[:, k_at] = np.where(sooner, own, best[:, k_at])
            new = i + np.flatnonzero(~found)
            names = np.insert(names, k[~found], np.stack([hi[new], lo[new]]), axis=1)
            best = np.insert(best, k[~found], np.stack([doc[new], a[new]]), axis=1)
        d, at = np.concatenate(late, axis=1) if late else np.zeros((2, 0), np.int64)
        return pa.table({"doc_id": d, "a": at, "b": at + length})

    return go


# --- the job --------------------------------------------------------------------------------------


def _compress(found: Sieve | None, inside: bool):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for k in range(0, len(batch), 1000):
                part = batch.slice(k, 1000)
                if found is not None:
                    part = part.filter(pa.array(found.may(part.column("doc_id").to_numpy()) == inside))
                at, data = flat(part.column("text"))
                raw = data.tobytes()
                z = [squeeze(raw[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(z, pa.binary())], ["doc_id", "z"])

    return go


def squeezed(docs: DataFrame, found: Sieve | None = None, inside: bool = True) -> DataFrame:
    """(doc_id, z): texts as they travel through a shuffle; with a sieve, those whose id may be in it, or else those whose id is not."""
    return docs.mapInArrow(lean(_compress(found, inside)), "doc_id long, z binary")


def _leaders(length: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for k in range(0, len(batch), 500):
                part = batch.slice(k, 500)
                out = {c: [] for c in ("shard", "cut", "doc_id", "start", "n", "bytes")}
                for doc, z, own in zip(part.column("doc_id").to_pylist(), part.column("z").to_pylist(), part.column("own").to_pylist(), strict=True):
                    text = expand(z)
                    for x in own:
                        if len(piece := text[x["start"] : x["start"] + x["n"] + length - 1]) == x["n"] + length - 1:
                            for c, v in (("shard", x["shard"]), ("cut", x["cut"]), ("doc_id", doc), ("start", x["start"]), ("n", x["n"]), ("bytes", piece)):
                                out[c].append(v)
                yield pa.RecordBatch.from_pydict(out, pa.schema([("shard", pa.int64()), ("cut", pa.bool_()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("bytes", pa.binary())]))

    return go


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, spans array<struct<a,b>>): the byte ranges of docs (doc_id, text), whose ids differ, that also occur earlier; rows without any are left out."""
    if not 0 < gram <= length:
        raise ValueError("a gram has 1 to length bytes")
    seen = docs.select("text").mapInArrow(lean(_values(length, gram)), "value long, n int")
    repeated = stash(seen.groupBy("value").agg(F.sum("n").alias("n")).where("n > 1").select("value"), "values")
    found = docs.mapInArrow(lean(_occurrences(length, gram, sieve(repeated))), "value long, key long, doc_id long, start long, n int, several boolean")
    found = stash(found.join(repeated, "value"), "runs")
    drop(repeated)

    first = F.min(F.struct("doc_id", "start")).alias("lead")
    classes = stash(found.groupBy("value", "key", "n").agg(first, F.count("*").alias("members"), F.max("several").alias("several")), "classes")
    copies = found.join(classes.where("members > 1").select("value", "key", "n", "lead"), ["value", "key", "n"])
    copies = copies.where("doc_id <> lead.doc_id or start <> lead.start").select("doc_id", F.col("start").alias("a"), (F.col("start") + F.col("n") + F.lit(length - 1)).alias("b"))
    copies = stash(copies, "copies")
    drop(found)

    size = F.sum(F.col("n").cast("long") + F.lit(length - 1)).alias("bytes")
    per_value = stash(classes.groupBy("value").agg(F.count("*").alias("leaders"), size, F.max("several").alias("odd")).where("leaders > 1 or odd").select("value", "bytes"), "leaders")
    shards = parts_for(per_value.agg(F.sum("bytes")).first()[0] or 0, SHARD)
    cells = F.ceil(F.col("bytes") / SPLIT)
    cut = F.col("bytes") > SPLIT
    # A cut value's shards lie beyond the others, each with its own number.
    shard = F.when(cut, F.lit(shards) + F.xxhash64("value", F.pmod(F.xxhash64("lead"), cells)).bitwiseAND(F.lit((1 << 62) - 1))).otherwise(F.pmod(F.xxhash64("value"), F.lit(shards)))
    own = classes.join(per_value, "value").select(F.col("lead.doc_id").alias("doc_id"), F.struct(shard.alias("shard"), cut.alias("cut"), F.col("lead.start").alias("start"), "n").alias("own"))
    own = stash(own.groupBy("doc_id").agg(F.collect_list("own").alias("own")), "own")
    drop(classes, per_value)
    segments = squeezed(docs, sieve(own.select("doc_id"))).join(own, "doc_id").mapInArrow(lean(_leaders(length)), "shard long, cut boolean, doc_id long, start long, n int, bytes binary")
    inside = stash(segments.groupBy("shard").applyInArrow(lean_group(_shard(length)), "doc_id long, a long, b long, digest binary, shard long"), "inside")
    drop(own)
    far = inside.where("digest is not null")
    ranges_ = parts_for(far.count(), 20_000)
    across = far.withColumn("range", F.pmod(F.xxhash64("digest"), F.lit(ranges_))).groupBy("range").applyInArrow(lean_group(_merge(length)), "doc_id long, a long, b long")
    spans = copies.unionByName(inside.where("digest is null").select("doc_id", "a", "b")).unionByName(across)
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("own"))
    spans = stash(spans.mapInArrow(_unite, "doc_id long, spans array<struct<a:long,b:long>>"), "spans")
    drop(copies, inside)
    return spans


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of each row in order, those that overlap or touch made one."""
    span = pa.struct([("a", pa.int64()), ("b", pa.int64())])
    for batch in batches:
        own = batch.column("own")
        at = own.offsets.to_numpy()
        a, b = (own.values.field(c).to_numpy() for c in ("a", "b"))
        lo, hi, ends = [], [], [0]
        for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            order = i + np.argsort(a[i:j], kind="stable")
            x, y = a[order], np.maximum.accumulate(b[order])
            first = np.flatnonzero(np.append(True, x[1:] > y[:-1]))
            lo.append(x[first])
            hi.append(y[np.append(first[1:], len(x)) - 1])
            ends.append(ends[-1] + len(first))
        both = pa.StructArray.from_arrays([pa.array(np.concatenate(c)) for c in (lo, hi)], fields=list(span)) if lo else pa.array([], span)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), both)], ["doc_id", "spans"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for k in range(0, len(batch), 500):
            part = batch.slice(k, 500)
            out = {c: [] for c in ("doc_id", "n_bytes", "n_removed", "spans", "kept")}
            for doc, z, own in zip(part.column("doc_id").to_pylist(), part.column("z").to_pylist(), part.column("spans").to_pylist(), strict=True):
                text = expand(z)
                spans, at, kept = [(x["a"], x["b"]) for x in own or []], 0, []
                for a, b in spans:
                    kept.append(text[at:a])
                    at = b
                kept.append(text[at:])
                for c, v in (("doc_id", doc), ("n_bytes", len(text)), ("n_removed", sum(b - a for a, b in spans)), ("spans", [{"a": a, "b": b} for a, b in spans]), ("kept", b"".join(kept))):
                    out[c].append(v)
            span = pa.struct([("a", pa.int64()), ("b", pa.int64())])
            yield pa.RecordBatch.from_pydict(out, pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(span)), ("kept", pa.binary())]))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans array<struct<a,b>>, kept binary): each text without its repeated bytes."""
    docs = texts(docs, id_col, text_col)
    rows = numbered(docs)
    if rows is not None:  # from here to the end a row's number stands for its id
        docs = rows.select(F.col("__row").alias("doc_id"), "text")
    spans = repeated_spans(docs, length, gram)
    found = sieve(spans.select("doc_id"))
    joined = squeezed(docs, found).join(spans, "doc_id", "left")
    if found is not None:  # texts that lose nothing stay where they are
        joined = joined.unionByName(squeezed(docs, found, inside=False), allowMissingColumns=True)
    out = joined.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, spans array<struct<a:long,b:long>>, kept binary")
    if rows is not None:
        columns = out.columns
        out = out.withColumnRenamed("doc_id", "__row").join(rows.select("__row", "doc_id"), "__row").select(*columns)
    return with_nulls(out)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's length, removed bytes and runs, and the digest of what stays."""
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op1_suffix_array_dedup": op1_suffix_array_dedup}
SQL: dict[str, str] = {}
