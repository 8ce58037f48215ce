"""Approximate nearest neighbours by inner product: vantage-point trees, one per shard.

An added coordinate makes all vectors of one length, so that the largest inner product is the least distance. A
tree node keeps a vantage point and the median distance to it; the triangle inequality says how near anything on the
far side can be. ``factor`` multiplies that gap before it is compared with the distance of the worst
answer so far: at one the search is exact, above it prunes more and may miss.

How it scales. Of rows with equal vectors only the k + 1 of smallest id can be answers, and only they are candidates; that many
pass the shuffle of each task. Candidates are dealt to shards of SHARD rows by a hash, queries to blocks of BLOCK; each block
meets each shard in a task of its own, that builds the shard's tree and walks it with the block's queries. A task
returns the k best of each query, and a window over k rows per shard picks the final ones. With a stated
query set the work is its size times the table's, in pieces of fixed size.

Ties. A matrix product may differ in its last bits from block to block, so a walk keeps SPARE answers more than k, and these are scored anew,
coordinate by coordinate in a fixed order, before they are ranked by (score, id). Where even the last of them is as good as the k-th to within
MARGIN, the query is compared with the whole shard. At factor one the result is thus exact, ties included.

Cases. Rows without an id and vectors that are null, zero, or hold null or non-finite components take no part. Vectors of another length
are no candidates of a query. Equal rows count once. Rows that share an id with different vectors are one candidate and one query, by the least
of their vectors. Fewer candidates than k give fewer rows, an empty table none. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import parts_for, stash, table
from ._vectors import matrix, sound

K, EVERY = 20, 20
SHARD, BLOCK, LEAF, FACTOR = 8192, 65_536, 128, 4.0
#: Queries walked at a time, answers kept beyond k, and the relative gap below which scores may be equal.
STEP, SPARE, MARGIN = 4096, 12, 1e-11


class VantageTree:
    """A tree over the rows of a matrix whose rows have one length in the added space."""

    def __init__(self, x: np.ndarray, reach: float, leaf: int = LEAF) -> None:
        self.x, self.reach = x, reach
        self.square = (x * x).sum(1)
        self.rng = np.random.default_rng(len(x))
        self.root = self._build(np.arange(len(x)), leaf)

    def _gap(self, i: int, rows: np.ndarray) -> np.ndarray:
        """Distances in the added space from row i to rows."""
        lift = np.sqrt(np.maximum(self.reach**2 - self.square[rows], 0)) * np.sqrt(max(self.reach**2 - self.square[i], 0))
        return np.sqrt(np.maximum(2 * self.reach**2 - 2 * (self.x[rows] @ self.x[i] + lift), 0))

    def _build(self, rows: np.ndarray, leaf: int):
        if len(rows) <= leaf:
            return np.sort(rows)
        point = int(rows[self.rng.integers(len(rows))])
        d = self._gap(point, rows)
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        inner, outer = rows[order[:half]], rows[order[half:]]
        return point, float(d[order[half - 1]]), float(d[order[half]]), self._build(inner, leaf), self._build(outer, leaf)


def plain(x: np.ndarray, at: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of each query with its rows ``at`` of x, summed coordinate by coordinate."""
    out = np.zeros(at.shape)
    for c in range(x.shape[1]):
        out += x[at, c] * q[:, c, None]
    return out


class Search:
    """The k best rows of a tree for a block of queries."""

    def __init__(self, tree: VantageTree, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int, factor: float) -> None:
        self.tree, self.ids, self.q, self.own, self.k, self.factor = tree, ids, q, own, k, factor
        self.square = (q * q).sum(1)
        k = self.k = k + SPARE
        self.score = np.full((len(q), k), -np.inf)
        self.found = np.full((len(q), k), np.iinfo(np.int64).max)
        self.visited = 0
        self.wanted = k - SPARE
        self._walk(tree.root, np.arange(len(q)))
        self._settle()

    def _settle(self) -> None:
        """Scores in one fixed order of sums; queries whose ties may go beyond the spare answers see the whole shard."""
        x, k = self.tree.x, self.wanted
        at = np.searchsorted(self.ids, np.minimum(self.found, self.ids[-1] if len(self.ids) else 0))
        there = self.score > -np.inf
        gap = MARGIN * np.sqrt(self.square) * self.tree.reach
        crowded = np.flatnonzero(there[:, -1] & (self.score[:, -1] >= self.score[:, k - 1] - gap))
        score = np.where(there, plain(x, at, self.q), -np.inf)
        best = np.lexsort((self.found, -score), axis=1)[:, :k]
        self.score, self.found = np.take_along_axis(score, best, 1), np.take_along_axis(self.found, best, 1)
        for i in crowded.tolist():
            s = x @ self.q[i]
            s[self.ids == self.own[i]] = -np.inf
            near = np.flatnonzero(s >= np.partition(s, -k)[-k] - gap[i])
            s = plain(x, near[None, :], self.q[i : i + 1])[0]
            near = near[np.lexsort((self.ids[near], -s))[:k]]
            self.score[i], self.found[i] = plain(x, near[None, :], self.q[i : i + 1])[0], self.ids[near]

    def _walk(self, node, live: np.ndarray) -> None:
        if not len(live):
            return
        if isinstance(node, np.ndarray):
            return self._leaf(node, live)
        point, inner, outer, left, right = node
        d = np.sqrt(np.maximum(self.square[live] + self.tree.reach**2 - 2 * (self.q[live] @ self.tree.x[point]), 0))
        near = d <= (inner + outer) / 2
        self._walk(left, live[near])
        self._walk(right, live[~near])
        # The other sides, unless even their nearest place is too far.
        far = np.sqrt(np.maximum(self.square[live] + self.tree.reach**2 - 2 * np.maximum(self.score[live, self.wanted - 1], -1e300), 0))
        far += 1e-6 * self.tree.reach  # distances of nearly equal vectors are known to half the digits only
        self._walk(right, live[near & ((outer - d) * self.factor <= far)])
        self._walk(left, live[~near & ((d - inner) * self.factor <= far)])

    def _leaf(self, rows: np.ndarray, live: np.ndarray) -> None:
        self.visited += len(rows) * len(live)
        s = self.q[live] @ self.tree.x[rows].T
        ids = self.ids[rows]
        s[self.own[live][:, None] == ids[None, :]] = -np.inf
        hit = np.flatnonzero(((s >= self.score[live, -1:]) & (s > -np.inf)).any(1))
        if not len(hit):
            return
        score = np.concatenate([self.score[live[hit]], s[hit]], 1)
        found = np.concatenate([self.found[live[hit]], np.broadcast_to(ids, (len(hit), len(ids)))], 1)
        best = np.lexsort((found, -score), axis=1)[:, : self.k]
        self.score[live[hit]] = np.take_along_axis(score, best, 1)
        self.found[live[hit]] = np.take_along_axis(found, best, 1)


def _meet(k: int, factor: float, reach: float):
    def go(t: pa.Table) -> pa.Table:
        asks = t.column("asks").to_numpy(zero_copy_only=False)
        ids, x = t.column("vec_id").to_numpy(), matrix(t.column("embedding"))
        q, c = np.flatnonzero(asks), np.flatnonzero(~asks)
        c = c[np.argsort(ids[c], kind="stable")]
        tree, out = VantageTree(x[c], reach), []
        for n in range(0, len(q) if len(c) else 0, STEP):
            own = q[n : n + STEP]
            s = Search(tree, ids[c], x[own], ids[own], k, factor)
            i, j = np.nonzero(s.score > -np.inf)
            out.append((ids[own][i], s.found[i, j], s.score[i, j]))
        query, found, score = (np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": query, "vec_id": found, "score": score})

    return go


def nearest(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, factor: float = FACTOR) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows where ``queries`` holds of vec_id, the k others of largest inner product found."""
    if factor < 1:
        raise ValueError("a factor below one only repeats exact search")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    rows = rows.where(sound("embedding") & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    rows = stash(rows, "vectors")
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    n, reach, asked = rows.agg(F.count("*"), F.coalesce(F.max(length), F.lit(1.0)), F.count_if(queries)).first()
    shards, blocks = parts_for(n, SHARD), parts_for(asked, BLOCK)
    alike = Window.partitionBy("embedding").orderBy("vec_id")
    able = rows.withColumn("no", F.row_number().over(alike)).where(F.col("no") <= k + 1)
    size = F.size("embedding").alias("size")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    at = lambda count: F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int")
    data = able.select("vec_id", "embedding", size, at(shards).alias("shard"), every(blocks).alias("block"), F.lit(False).alias("asks"))
    asks = rows.where(queries).select("vec_id", "embedding", size, at(blocks).alias("block"), every(shards).alias("shard"), F.lit(True).alias("asks"))
    found = data.unionByName(asks).groupBy("size", "shard", "block").applyInArrow(_meet(k, factor, reach * (1 + 1e-12)), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector's twenty nearest among all others."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


QUERIES = {"op6_nearest_neighbours": op6_nearest_neighbours}
SQL: dict[str, str] = {}
