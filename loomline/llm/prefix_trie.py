"""Trie of conversation prefixes by vertical bitmaps.

Conversations are numbered in the order of their ids and dealt to shards of consecutive numbers, their turns to blocks of depth. In a
piece (shard, block) each (position, turn) has a posting, the bitset of conversations that hold it. A depth-first walk
intersects a node's bitset with the postings at the next position: each intersection is a child, its popcount the child's
conversations in the shard, the members without a next turn its list of ends. A node's members lie together in the order of the
walk, so any sum over them is a difference of two prefix sums. Nodes of different shards are one if depth and the digest of their
turns agree (128 bits).

Sums over a subtree need no recursion by depth. A node belongs to its smallest member, and what a conversation owns is the
rest of its path from some depth on. For a node with members M, of which r is the smallest, the text below it, told once per node,
is the rest of r's path and all that the others in M own; its leaves are the members that own a childless node.

How it scales. Texts become digests before anything is shuffled. Turns are sorted by range over conversations and turns, so one conversation may
fill many tasks; positions are counted within tasks, and only one carry for each task passes through the driver. A piece holds at most SHARD
conversations times DEPTH turns, whatever the lengths. A node that all conversations share is one row for each shard; the sums
of these are partial before they are shuffled. SHA-256 has no parallel form: a node's end lists, at most one for each shard, pass in
order through one task that keeps the state of the digest only.

Cases. Turns go by number, null first, ties by the MD5 of role and text; null roles and texts are empty; repeated rows are
repeated turns. Rows without a conv_id belong to no conversation and take no part. Negative ids have a negative remainder, as in SQL. An empty table gives no rows, not even a root.
Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._arrays import heads, ranges
from ._spark import drop, stash, table

SHARD, DEPTH = 2048, 64
#: Blocks of one conversation whose digests are joined in one task.
STRETCH = 1024
#: Conversations whose ids agree but for the last two digits begin alike in op11, for at most HEAD - 1 turns.
FAMILY, HEAD = 100, 6

KEY = ["depth", "k1", "k2"]
MARK = {"at": -1, "a": 0, "b": 0, "chars": 0}
GROWN = "shard long, block long, node boolean, depth long, k1 long, k2 long, p1 long, p2 long, conv_id long, n long, ends long, chars long, rest long, own long, at long, ended string"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns with the number of their conversation in this task (local) and their own in it (k)."""
    part, last, local, k = TaskContext.get().partitionId(), None, -1, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column("conv_id").to_numpy()
        first = heads(conv)
        size = np.diff(np.append(first, len(conv)))
        again = int(conv[0] == last)
        no = np.repeat(local + 1 - again + np.arange(len(first)), size)
        pos = np.arange(len(conv)) - np.repeat(first, size)
        if again:
            pos[: size[0]] += k
        last, local, k = int(conv[-1]), int(no[-1]), int(pos[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(conv), part)), pa.array(no), pa.array(pos)], [*batch.schema.names, "part", "local", "k"])


def positions(turns: DataFrame) -> DataFrame:
    """(conv_id, ordinal, at, a, b, chars): conversations numbered by id, their turns from 0, a digest of each turn and the code points of its text."""
    spark = turns.sparkSession
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(" "), role, text))
    long = lambda start: F.conv(F.substring("digest", start, 16), 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63)))  # noqa: E731  in the order of the digest
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    rows = rows.select("conv_id", "turn", long(1).alias("a"), long(17).alias("b"), "chars").withColumn("salt", F.rand(1))  # rows alike in all spread, too
    order = ["conv_id", F.col("turn").asc_nulls_first(), "a", "b", "salt"]
    rows = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).select("conv_id", "a", "b", "chars")
    rows = stash(rows.mapInArrow(_counted, "conv_id long, a long, b long, chars long, part long, local long, k long"), "turns")
    carries, before, ordinal, carry = [], None, 0, 0
    tail = F.max(F.struct("local", "k"))
    for p in rows.groupBy("part").agg(F.min("conv_id").alias("first"), F.max("conv_id").alias("last"), tail.alias("tail")).orderBy("part").collect():  # a row for each task
        same = p["first"] == before
        start, carry = ordinal - same, carry if same else 0
        carries.append((p["part"], start, carry))
        ordinal, before = start + p["tail"]["local"] + 1, p["last"]
        carry = p["tail"]["k"] + 1 + (carry if p["tail"]["local"] == 0 else 0)
    carries = F.broadcast(spark.createDataFrame(carries, "part long, start long, carry long"))
    at = F.col("k") + F.when(F.col("local") == 0, F.col("carry")).otherwise(0)
    return rows.join(carries, "part").select("conv_id", (F.col("start") + F.col("local")).alias("ordinal"), at.alias("at"), "a", "b", "chars")


def marked(turns: DataFrame) -> DataFrame:
    """positions() with a mark of each conversation, at -1, so that those without turns count."""
    return turns.unionByName(turns.where("at = 0").select("conv_id", "ordinal", *[F.lit(x).cast("long").alias(c) for c, x in MARK.items()]))


def rebuilt(turns: DataFrame) -> DataFrame:
    """marked() for conversations that begin with the first h turns of their family's first one and go on with their own after h; h is the id's CRC-32 modulo HEAD."""
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).cast("int")
    turn = F.struct("at", "a", "b", "chars")
    first = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("at") < HEAD - 1)).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(turn)).alias("head"))  # HEAD - 1 at most
    none = F.array().cast(f"array<{turns.select(turn).schema[0].dataType.simpleString()}>")
    joined = turns.withColumn("base", base).join(first, "base", "left").withColumn("head", F.slice(F.coalesce("head", none), 1, h))
    mark = F.struct(*[F.lit(x).cast("long").alias(c) for c, x in MARK.items()])
    own = F.struct((F.col("at") - h + F.size("head")).alias("at"), "a", "b", "chars")
    every = F.concat(F.when(F.col("at") == 0, F.concat(F.array(mark), "head")).otherwise(none), F.when(F.col("at") >= h, F.array(own)).otherwise(none))
    return joined.select("conv_id", "ordinal", F.inline(every))


def _along(blocks: DataFrame) -> DataFrame:
    """Of each block of a long conversation: the digest of all turns before it and the code points after it, -1 in the last. Blocks are joined within stretches, then stretches."""
    blocks = blocks.withColumn("far", F.floor(F.col("block") / STRETCH))
    near = Window.partitionBy("conv_id", "far").orderBy("block")
    wide = Window.partitionBy("conv_id").orderBy("far")

    def sides(w: Window) -> list[Column]:
        before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
        return [*[F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(f"{c}_") for c in ("p1", "p2")], F.sum("chars").over(after).alias("chars_")]

    far = blocks.groupBy("conv_id", "far").agg(F.bit_xor("p1").alias("p1"), F.bit_xor("p2").alias("p2"), F.sum("chars").alias("chars"))
    far = far.select("conv_id", "far", *sides(wide)).alias("f")
    out = blocks.select("conv_id", "far", "block", "shard", "bit", *sides(near)).alias("b").join(far, ["conv_id", "far"])
    later = F.when(F.col("b.chars_").isNull() & F.col("f.chars_").isNull(), -1).otherwise(F.coalesce("b.chars_", F.lit(0)) + F.coalesce("f.chars_", F.lit(0)))
    digest = [F.col(f"b.{c}_").bitwiseXOR(F.col(f"f.{c}_")).alias(c) for c in ("p1", "p2")]
    return out.select("shard", "block", "bit", "conv_id", F.lit(-2).cast("long").alias("at"), *digest, later.alias("chars"))


def bitset(members: np.ndarray, size: int) -> int:
    own = np.zeros(size, bool)
    own[members] = True
    return int.from_bytes(np.packbits(own, bitorder="little").tobytes(), "little")


def bits_of(x: int, size: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(x.to_bytes(-(-size // 8), "little"), np.uint8), bitorder="little"))


class Piece:
    """The nodes of one shard and block. Rows are turns in the order of (conversation, position); first and size give each conversation's."""

    def __init__(self, first: np.ndarray, size: np.ndarray, turn: tuple[np.ndarray, np.ndarray], pos: np.ndarray, starts: list[np.ndarray], root: bool) -> None:
        self.n, self.first, self.size = len(first), first, size
        self.rank = np.zeros(self.n, np.int64)
        self.nodes: list[tuple[int, int, int]] = []  # row of the smallest member, members, first place of them
        self.ends: dict[int, np.ndarray] = {}  # of the nodes with members that stop there, by the node's number
        self.chains: list[tuple[int, int, int]] = []  # conversation alone from here on: itself, its next row, its place
        self._post(turn, pos)
        place = 0
        if root:
            self._walk([(self._all(np.arange(self.n)), 0, 0, -1)])
        else:
            for own in starts:
                self._walk([(self._all(own), 0, place, None)])
                place += len(own)

    def _all(self, members: np.ndarray) -> int:
        return bitset(members, self.n)

    def _post(self, turn: tuple[np.ndarray, np.ndarray], pos: np.ndarray) -> None:
        """The posting of each row, and for each position the conversations that have it."""
        conv = np.repeat(np.arange(self.n), self.size)
        order = np.lexsort((conv, turn[1], turn[0], pos))
        begin = heads(pos[order], turn[0][order], turn[1][order])
        stop = np.append(begin, len(order))[1:]
        self.posting: list[int] = []
        self.of = np.zeros(len(order), np.int64)
        self.of[order] = np.repeat(np.arange(len(begin)), stop - begin)
        for i, j in zip(begin.tolist(), stop.tolist(), strict=True):
            self.posting.append(1 << int(conv[order[i]]) if j - i == 1 else bitset(conv[order[i:j]], self.n))
        self.alive = [bitset(np.flatnonzero(self.size > d), self.n) for d in range(int(self.size.max(initial=0)) + 1)]

    def _walk(self, stack: list) -> None:
        """From (bitset, turns of the block so far, first place, row): children are pushed, members without a next turn placed."""
        first, of, posting = self.first.tolist(), self.of.tolist(), self.posting
        while stack:
            bits, depth, place, row = stack.pop()
            n = bits.bit_count()
            if row is not None:
                self.nodes.append((row, n, place))
            if n == 1:
                i = bits.bit_length() - 1
                self.rank[i] = place
                if self.size[i] > depth:
                    self.chains.append((i, first[i] + depth, place))
                elif row is not None:
                    self.ends[len(self.nodes) - 1] = np.array([i])
                continue
            left = bits & self.alive[depth]
            if left != bits:
                done = bits_of(bits ^ left, self.n)
                self.rank[done] = place + np.arange(len(done))
                place += len(done)
                if row is not None:
                    self.ends[len(self.nodes) - 1] = done
            while left:
                i = (left & -left).bit_length() - 1
                r = first[i] + depth
                child = bits & posting[of[r]]
                left ^= child
                stack.append((child, depth + 1, place, r))
                place += child.bit_count()


def _grow(depth: int):
    def go(t: pa.Table) -> pa.Table:
        """Node rows of one piece, and a row for each conversation with its place in the walk."""
        shard, block = t.column("shard")[0].as_py(), t.column("block")[0].as_py()
        t = t.sort_by([("bit", "ascending"), ("at", "ascending")])
        bit, conv, at, p1, p2, chars = (t.column(c).to_numpy() for c in ("bit", "conv_id", "at", "p1", "p2", "chars"))
        begin = heads(bit)
        name = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(bit))))
        ids, n = conv[begin], len(begin)
        k1, k2, later = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1)
        far, turn = at == -2, at >= 0
        k1[name[far]], k2[name[far]], later[name[far]] = p1[far], p2[far], chars[far]
        name, at, p1, p2, chars = name[turn], at[turn], p1[turn], p2[turn], chars[turn]
        size = np.bincount(name, minlength=n)
        first = np.cumsum(size) - size
        starts = []
        if block:
            order = np.lexsort((np.arange(n), k2, k1))
            starts = np.split(order, heads(k1[order], k2[order])[1:])
        piece = Piece(first, size, (p1, p2), at, starts, not block)

        upto = lambda x, op: op.accumulate(np.concatenate([np.zeros(1, np.int64), x]))
        x1, x2, sums = upto(p1, np.bitwise_xor), upto(p2, np.bitwise_xor), upto(chars, np.add)
        total = sums[first + size] - sums[first] + np.maximum(later, 0)  # code points of each conversation from the block on
        # Nodes: those of the walk, then those of conversations alone.
        row, members, place = (np.array(c, np.int64) for c in zip(*piece.nodes, strict=True)) if piece.nodes else (np.zeros(0, np.int64),) * 3
        i, r, p = (np.array(c, np.int64) for c in zip(*piece.chains, strict=True)) if piece.chains else (np.zeros(0, np.int64),) * 3
        count = first[i] + size[i] - r
        row, members, place = np.concatenate([row, ranges(r, count)]), np.concatenate([members, np.ones(count.sum(), np.int64)]), np.concatenate([place, np.repeat(p, count)])
        ended, stops = np.full(len(row), None, object), np.zeros(len(row), np.int64)
        lists = [*piece.ends.items(), *zip((len(piece.nodes) + np.cumsum(count) - 1).tolist(), i.reshape(-1, 1), strict=True)]
        for node, own in lists:
            own = own[later[own] < 0]
            if len(own):
                ended[node], stops[node] = ",".join(map(str, ids[own].tolist())), len(own)

        by_place = np.argsort(piece.rank)
        below = upto(total[by_place], np.add)
        root = row < 0
        safe = np.maximum(row, 0)
        least = np.where(root, 0, name[safe] if len(name) else 0)
        key = lambda x, k, upper: np.where(root, 0, x[np.minimum(safe + 1 - upper, len(x) - 1)] ^ x[first[least]] ^ k[least])
        before = np.where(root, 0, sums[safe] - sums[first[least]])  # code points of the block's turns above the node
        none = np.zeros(n, np.int64)
        cols = {
            "shard": np.full(len(row) + n, shard), "block": np.full(len(row) + n, block), "node": np.append(np.ones(len(row), bool), np.zeros(n, bool)),
            "depth": np.append(np.where(root, 0, at[safe] + 1 if len(at) else 0), none), "k1": np.append(key(x1, k1, 0), none), "k2": np.append(key(x2, k2, 0), none), "p1": np.append(key(x1, k1, 1), none), "p2": np.append(key(x2, k2, 1), none),
            "conv_id": np.append(ids[least], ids), "n": np.append(members, none), "ends": np.append(stops, none), "chars": np.append(np.where(root | (len(chars) == 0), 0, chars[safe] if len(chars) else 0), none),
            "rest": np.append(below[place + members] - below[place] - members * before, none), "own": np.append(total[least] - before, none), "at": np.append(place, piece.rank), "ended": np.append(ended, np.full(n, None, object)),
        }
        return pa.table({c: pa.array(v, pa.string() if c == "ended" else None) for c, v in cols.items()})

    return go


def _weigh(nodes: pa.Table, order: pa.Table) -> pa.Table:
    """Node rows of a piece with sums over their members: leaves, what these own, and what their least member owns."""
    order = order.sort_by("place")
    owns, leaf, ids = (order.column(c).to_numpy() for c in ("owns", "leaf", "member"))
    owned, leaves = (np.append(0, np.cumsum(x)) for x in (owns, leaf))
    at, n, conv = (nodes.column(c).to_numpy() for c in ("at", "n", "conv_id"))
    by_id = np.argsort(ids)
    least = owns[by_id[np.searchsorted(ids[by_id], conv)]] if len(conv) else np.zeros(0, np.int64)
    rest, own = nodes.column("rest").to_numpy(), nodes.column("own").to_numpy()
    return pa.table({
        **{c: nodes.column(c) for c in KEY}, "conv_id": conv, "n": n, "leaves": leaves[at + n] - leaves[at],
        "saved": rest - (owned[at + n] - owned[at]), "back": least - own,
    })


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's end lists, joined by commas, from rows in order of (node, shard)."""
    last, state = None, None
    for batch in batches:
        out = []
        for *key, ended in zip(*[batch.column(c).to_pylist() for c in (*KEY, "ended")], strict=True):
            if key == last:
                state.update(b"," + ended.encode())
            else:
                if last is not None:
                    out.append((*last, state.hexdigest()))
                last, state = key, hashlib.sha256(ended.encode())
        yield _rows(out)
    if last is not None:
        yield _rows([(*last, state.hexdigest())])


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], [*KEY, "sha"])


def trie(turns: DataFrame, shard: int = SHARD, depth: int = DEPTH) -> DataFrame:
    """One row per node of marked() turns: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, chars."""
    turn = F.col("at") >= 0
    rows = turns.select(
        F.floor(F.col("ordinal") / shard).alias("shard"), F.when(turn, F.floor(F.col("at") / depth)).otherwise(0).cast("long").alias("block"), (F.col("ordinal") % shard).alias("bit"),
        "conv_id", "at", F.xxhash64("at", "a", "b").alias("p1"), F.xxhash64("b", "a", "at").alias("p2"), "chars",
    )
    rows = stash(rows, "steps")
    long = rows.where(F.col("at") == depth).select("conv_id")
    blocks = rows.where("at >= 0").join(long, "conv_id", "left_semi").groupBy("conv_id", "shard", "bit", "block").agg(F.bit_xor("p1").alias("p1"), F.bit_xor("p2").alias("p2"), F.sum("chars").alias("chars"))
    pieces = rows.unionByName(_along(blocks)).groupBy("shard", "block")
    grown = stash(pieces.applyInArrow(_grow(depth), GROWN), "grown")
    drop(rows)
    nodes = grown.where("node").groupBy(*KEY).agg(F.min(F.struct("conv_id", "own")).alias("least"), F.sum("n").alias("n"), F.sum("ends").alias("ends"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("chars").alias("chars"))
    nodes = stash(nodes.select(*KEY, "least.conv_id", "least.own", (F.col("n") == F.col("ends")).alias("childless"), "p1", "p2", "chars"), "nodes")
    values = nodes.groupBy("conv_id").agg(F.max("own").alias("owns"), F.max("childless").cast("long").alias("leaf"))
    order = grown.where("not node").select(F.col("shard").alias("shard_"), F.col("block").alias("block_"), "conv_id", F.col("at").alias("place")).join(values, "conv_id", "left")
    order = order.select("shard_", "block_", F.col("conv_id").alias("member"), "place", F.coalesce("owns", F.lit(0)).alias("owns"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    own = grown.where("node").select("shard", "block", *KEY, "conv_id", "n", "rest", "own", "at")
    sums = own.groupBy("shard", "block").cogroup(order.groupBy("shard_", "block_")).applyInArrow(_weigh, "depth long, k1 long, k2 long, conv_id long, n long, leaves long, saved long, back long")
    ends = grown.where("ended is not null").select(*KEY, "shard", "ended").repartition(*KEY).sortWithinPartitions(*KEY, "shard").mapInArrow(_hashed, "depth long, k1 long, k2 long, sha string")
    children = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.lit(1).alias("child"))
    every = sums.unionByName(children, allowMissingColumns=True).unionByName(ends, allowMissingColumns=True)
    back = F.min(F.when(F.col("conv_id").isNotNull(), F.struct("conv_id", "back"))).alias("back")
    every = every.groupBy(*KEY).agg(back, F.sum("n").alias("n"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.coalesce(F.sum("child"), F.lit(0)).alias("children"), F.max("sha").alias("sha"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    above = nodes.select(*KEY, "p1", "p2", "chars").where("depth > 0").join(parents, ["depth", "p1", "p2"]).select(*KEY, "parent_conv_id", "chars")
    return every.join(above, KEY, "left").select(
        F.col("back.conv_id").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved") + F.col("back.back")).alias("saved_tokens"), F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), F.coalesce("chars", F.lit(0)).alias("chars"),
    )


def prefix_trie(turns: DataFrame, shard: int = SHARD, depth: int = DEPTH) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) as they are."""
    return trie(marked(positions(turns)), shard, depth)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each begun like the first of its hundred."""
    return trie(rebuilt(positions(table(spark, sf_dir, "conversations")))).drop("chars")


QUERIES = {"op11_prefix_trie": op11_prefix_trie}
SQL = {
    "op11_prefix_trie": """
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ' ' || coalesce(role, '') || coalesce(text, ''))) - 1 AS k,
    coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), z AS (
  SELECT DISTINCT c, c - c % 100 AS base, (SELECT bit_xor(0)) AS zero FROM t
), crc(c, h) AS (
  SELECT c, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i::BIGINT, 1))::BIGINT)), lambda acc, x:
    list_reduce([xor(acc, x), 1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[], lambda v, s: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)) FROM z
), h AS (SELECT c, xor(h, 4294967295) % 6 AS h FROM crc),
head AS (SELECT z.c, t.k, t.role, t.text FROM z JOIN h USING (c) JOIN t ON t.c = z.base AND t.k < h.h),
m AS (SELECT c, count(*) AS m FROM head GROUP BY c),
r AS (
  SELECT * FROM head
  UNION ALL SELECT t.c, t.k - h.h + coalesce(m.m, 0), t.role, t.text FROM t JOIN h USING (c) LEFT JOIN m USING (c) WHERE t.k >= h.h
), p AS MATERIALIZED (
  SELECT c, k + 1 AS d, length(text) AS chars, list({'role': role, 'text': text}) OVER (PARTITION BY c ORDER BY k) AS path FROM r
  UNION ALL SELECT c, 0, 0, [] FROM z
), q AS MATERIALIZED (
  SELECT c, d, chars, md5(path::JSON::VARCHAR) AS key, CASE WHEN d > 0 THEN md5(path[:-2]::JSON::VARCHAR) END AS up, d = max(d) OVER (PARTITION BY c) AS stops FROM p
), n AS MATERIALIZED (
  SELECT key, d, any_value(up) AS up, min(c) AS conv_id, count(*) AS n, any_value(chars) AS chars,
    coalesce(string_agg(CASE WHEN stops THEN c::VARCHAR END, ',' ORDER BY c), '') AS ended, count(*) FILTER (WHERE stops) AS ends
  FROM q GROUP BY key, d
), s AS (
  SELECT a.key, a.d, sum((n.n - 1) * n.chars) AS saved, count(*) FILTER (WHERE n.n = n.ends) AS leaves
  FROM n JOIN q b ON b.c = n.conv_id AND b.d = n.d JOIN q a ON a.c = b.c AND a.d <= b.d GROUP BY a.key, a.d
), k AS (SELECT up, d - 1 AS d, count(*) AS children FROM n WHERE d > 0 GROUP BY up, d)
SELECT n.conv_id, n.d::BIGINT AS depth, o.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(k.children, 0) AS n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(n.ended) AS ends_sha256
FROM n JOIN s ON s.key = n.key AND s.d = n.d LEFT JOIN n o ON o.key = n.up AND o.d = n.d - 1 LEFT JOIN k ON k.up = n.key AND k.d = n.d
""",
}
