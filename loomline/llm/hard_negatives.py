"""Hard negatives by an inverted multi-index.

The vectors of a shard are coded twice, their first halves by one codebook and their second halves by another; a pair of codes is a cell.
For an anchor, a half's score with any member of a code is at most its score with the code's centre plus its length times the code's
radius. A heap over the two lists of half bounds, each in falling order, visits cells by the sums of their bounds. A window, the best few
within a range of scores, is certified once no further cell can reach its worst answer, or its lower end; when all windows of an anchor are,
the search stops. Results are exact.

How it scales. Components become integers in the scan. Rows are dealt to shards of SHARD by a hash of the id, so no label can fill one, and anchors to
blocks of BLOCK; each block meets each shard in a task of its own, that trains both codebooks on the shard's own rows and walks it for
every anchor. First each anchor's positives are found over all shards, then, with the windows that their scores give, its
negatives; a task returns the best few of each window, and a window function over these picks the final ones. With anchors as a stated query set the
work is their number times the table's, in pieces of fixed size.

Cases. Rows without an id or label, with a null vector or a null or non-finite component take no part; zero vectors do. Rows alike count once; of rows
that share an id that of least (label, vector) counts. Only vectors of the anchor's length meet it. Scores are exact for components up to 2**26 after scaling,
where larger ones are held, in up to 2,048 dimensions. Ties go to the smaller id. An anchor without positives, or a positive without negatives in its window, has no rows. An
empty table gives none. Extra columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import parts_for, stash, table

SCALE, POSITIVES, NEGATIVES, LEAST, MOST = 256, 5, 10, 30, 90
#: Rows of a shard, anchors of a block, codes of a half, rounds of its training, and rows scored at once.
SHARD, BLOCK, CODES, ROUNDS, STEP = 16_384, 8192, 16, 4, 1024
HELD = 1 << 26


def codebook(x: np.ndarray, codes: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centres, radius of each, code of each row) by Lloyd's rounds from rows drawn with a fixed seed."""
    centres = x[np.sort(np.random.default_rng(len(x)).choice(len(x), min(codes, len(x)), replace=False))].astype(np.float64)
    square = (x * x).sum(1)
    for k in range(rounds + 1):
        gap = square[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :]
        code = gap.argmin(1)
        if k < rounds:
            sums = np.zeros_like(centres)
            np.add.at(sums, code, x)
            n = np.bincount(code, minlength=len(centres))
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    radius = np.zeros(len(centres))
    np.maximum.at(radius, code, np.sqrt(((x - centres[code]) ** 2).sum(1)))
    return centres, radius, code


class MultiIndex:
    """Rows of one shard in cells of two half codes."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, label: np.ndarray, codes: int = CODES) -> None:
        half = x.shape[1] // 2
        self.half, self.reach = half, float(np.sqrt((x * x).sum(1).max(initial=0)))
        self.books = [codebook(x[:, :half], codes), codebook(x[:, half:], codes)]
        self.codes = len(self.books[1][0])
        cell = self.books[0][2] * self.codes + self.books[1][2]
        order = np.lexsort((ids, cell))
        exact = float(np.abs(x).max(initial=0)) ** 2 * max(x.shape[1], 1) < 1 << 53
        self.x = x[order] if exact else x[order].astype(np.int64)
        self.ids, self.label = ids[order], label[order]
        self.edge = np.searchsorted(cell[order], np.arange(len(self.books[0][0]) * self.codes + 1))
        self.scored = 0

    def bounds(self, q: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half (upper, lower) bounds of every anchor's score with every code."""
        out = []
        for (centres, radius, _), own in zip(self.books, (q[:, : self.half], q[:, self.half :]), strict=True):
            size = np.sqrt((own * own).sum(1))
            middle, slack = own @ centres.T, size[:, None] * (radius * (1 + 1e-9) + 1e-9 * self.reach)[None, :] + 1e-6
            out.append((middle + slack, middle - slack))
        return out

    def rows_by_bound(self, upper: list[np.ndarray], lower: list[np.ndarray], highest: float):
        """(bound of what follows, rows) of non-empty cells that may hold a score up to ``highest``, falling by the sum of their half bounds."""
        a, b = (np.argsort(-u, kind="stable").tolist() for u in upper)
        up, low, edge = [u.tolist() for u in upper], [v.tolist() for v in lower], self.edge
        heap = [(-(up[0][a[0]] + up[1][b[0]]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (-(up[0][a[i + 1]] + up[1][b[0]]), i + 1, 0))
            if j + 1 < len(b):
                heapq.heappush(heap, (-(up[0][a[i]] + up[1][b[j + 1]]), i, j + 1))
            cell = a[i] * self.codes + b[j]
            if edge[cell] < edge[cell + 1] and low[0][a[i]] + low[1][b[j]] <= highest:
                yield -bound, np.arange(edge[cell], edge[cell + 1])

    def best(self, q: np.ndarray, bounds: list[tuple[np.ndarray, np.ndarray]], able: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) for each window (least, most) of scores: the k best of the able rows within it, ties to the smaller id."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
        floor = [float(lo) for lo, _ in windows]  # what a score must reach to matter
        open_ = [w for w, (lo, hi) in enumerate(windows) if lo <= hi]
        rows, waiting = [], 0
        visits = self.rows_by_bound([u for u, _ in bounds], [v for _, v in bounds], max((windows[w][1] for w in open_), default=0)) if open_ else iter(())
        for bound, own in visits:
            if any(bound < floor[w] for w in open_):  # some window is certified, once what waits is scored
                if rows:
                    self._score(q, np.concatenate(rows), able, windows, open_, found, floor, k)
                    rows, waiting = [], 0
                open_ = [w for w in open_ if bound >= floor[w]]
                if not open_:
                    break
            rows.append(own)
            waiting += len(own)
            if waiting >= STEP:
                self._score(q, np.concatenate(rows), able, windows, open_, found, floor, k)
                rows, waiting = [], 0
        if rows:
            self._score(q, np.concatenate(rows), able, windows, open_, found, floor, k)
        return found

    def _score(self, q: np.ndarray, rows: np.ndarray, able: np.ndarray, windows: list, open_: list[int], found: list, floor: list[float], k: int) -> None:
        rows = rows[able[rows]]
        self.scored += len(rows)
        score = (self.x[rows] @ q.astype(self.x.dtype)).astype(np.int64)
        for w in open_:
            lo, hi = windows[w]
            hit = np.flatnonzero((score >= max(lo, floor[w])) & (score <= hi))
            if len(hit):
                ids, s = np.append(found[w][0], self.ids[rows[hit]]), np.append(found[w][1], score[hit])
                top = np.lexsort((ids, -s))[:k]
                found[w] = ids[top], s[top]
                if len(top) == k:
                    floor[w] = float(s[top[-1]])


def window_of(positive: int, least: int, most: int) -> tuple[int, int]:
    """Scores s with least * positive <= 100 * s <= most * positive."""
    return -(-least * positive // 100), most * positive // 100


def _sides(t: pa.Table) -> tuple[np.ndarray, ...]:
    asks = t.column("asks").to_numpy(zero_copy_only=False)
    ids, label = t.column("vec_id").to_numpy(), t.column("label").to_numpy()
    x = t.column("v").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(t), t.column("size")[0].as_py())
    return np.flatnonzero(asks), np.flatnonzero(~asks), ids, label, x


ANY = 1 << 62


def _positives(k: int):
    def go(t: pa.Table) -> pa.Table:
        """The k best rows of each anchor's label, the anchor apart."""
        q, c, ids, label, x = _sides(t)
        out = []
        if len(q) and len(c):
            index = MultiIndex(x[c], ids[c], label[c])
            halves = index.bounds(x[q])
            for n, i in enumerate(q.tolist()):
                ((found, score),) = index.best(x[i], [(u[n], v[n]) for u, v in halves], (index.label == label[i]) & (index.ids != ids[i]), [(-ANY, ANY)], k)
                out.append((np.full(len(found), ids[i]), found, score))
        cols = [np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(["anchor_id", "positive_id", "positive_score"], cols, strict=True)))

    return go


def _negatives(k: int, least: int, most: int):
    def go(t: pa.Table) -> pa.Table:
        """The k best rows of other labels in the window of each anchor's positives."""
        q, c, ids, label, x = _sides(t)
        wanted, out = t.column("positives"), []
        if len(q) and len(c):
            index = MultiIndex(x[c], ids[c], label[c])
            halves = index.bounds(x[q])
            for n, i in enumerate(q.tolist()):
                own = wanted[i].as_py()
                windows = [window_of(p["positive_score"], least, most) for p in own]
                for p, (found, score) in zip(own, index.best(x[i], [(u[n], v[n]) for u, v in halves], index.label != label[i], windows, k), strict=True):
                    out.append((np.full(len(found), ids[i]), np.full(len(found), p["positive_id"]), found, np.full(len(found), p["positive_score"]), score))
        cols = [np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
        return pa.table(dict(zip(["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"], cols, strict=True)))

    return go


def mine(
    vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE,
    positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For rows where ``anchors`` holds of vec_id: the best other rows of the same label, and for each of these the best rows of other labels whose
    score lies between ``least`` and ``most`` hundredths of the positive's.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))
    held = lambda x: F.greatest(F.lit(-HELD), F.least(F.lit(HELD), F.floor(x.cast("double") * scale))).cast("int")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("x"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).where(F.forall("x", finite))
    rows = rows.select("vec_id", F.struct("label", F.transform("x", held).alias("v")).alias("row")).groupBy("vec_id").agg(F.min("row").alias("row"))
    rows = stash(rows.select("vec_id", "row.label", "row.v", F.size("row.v").alias("size")), "vectors")
    n, asked = rows.agg(F.count("*"), F.count_if(anchors)).first()
    shards, blocks = parts_for(n, SHARD), parts_for(asked, BLOCK)
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    at = lambda count: F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int")
    piece = ["size", "shard", "block"]
    data = rows.select("*", at(shards).alias("shard"), every(blocks).alias("block"), F.lit(False).alias("asks"))
    asks = rows.where(anchors).select("*", at(blocks).alias("block"), F.lit(True).alias("asks"))

    met = data.unionByName(asks.withColumn("shard", every(shards))).groupBy(*piece)
    near = met.applyInArrow(_positives(positives), "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives)
    near = stash(near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives")), "positives")  # a few for each anchor
    asks = asks.join(near, "vec_id").withColumn("shard", every(shards))
    met = data.withColumn("positives", F.lit(None).cast(near.schema["positives"].dataType)).unionByName(asks).groupBy(*piece)
    found = met.applyInArrow(_negatives(negatives, least, most), "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives for every hundredth vector and its five positives; every seventh vector is taken for the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


QUERIES = {"op13_hard_negatives": op13_hard_negatives}
SQL = {
    "op13_hard_negatives": """
WITH v AS (
  SELECT vec_id, min({'label': CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END, 'v': list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT)}) AS r
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor, b.vec_id AS other, a.r.label = b.r.label AS same, list_sum(list_transform(list_zip(a.r.v, b.r.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND len(a.r.v) = len(b.r.v) AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor, other AS positive, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5
)
SELECT p.anchor AS anchor_id, p.positive AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.positive ORDER BY s.score DESC, s.other) AS rank,
  s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10
""",
}
