"""Embedding near-dedup by a subspace pigeonhole join: vectors of one label with cosine of ``threshold`` or more.

Unit vectors are rotated at random and cut into blocks of coordinates. If two lie within squared distance
2 - 2 * threshold, then in some block they lie within that block's part of it. So each block is joined alone:
vectors meet in cells, as wide as the block's radius, over one of its coordinates and one more each time the label's size
doubles beyond GRID, as far as COPIES allows, and in half of the neighbouring cells. Inside a cell, pairs within the block's part are candidates, and
each is verified on the original vectors in double precision. A pair counts in the first block that offers it.

How it scales. A vector has at most COPIES cells (40 with eight blocks), whatever the label's size. Cells are counted and cut on narrow rows of numbers;
the vector itself joins what is left once, and only cells where it has company. A cell of more than CELL numbers is cut into blocks of rows
that meet in pairs, so a large group of near copies is spread over tasks and each of its rows travels once per block. Tasks return counts and a spanning
forest, never pairs. Rows with equal vectors under one label are one class, compared once, whose copies count as links.

Cases. Vectors that are null, zero, or hold null or non-finite components, and those without a label, link with
nothing and stay. Vectors of different length never meet. Labels may be of any type that casts to text. Every row is a vector of its own, those
that share an id too; a null id comes after all others, and one row of a component is kept. An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._graph import components, in_blocks, roots
from ._spark import NO_ID, numbered, parts_for, stash, table, with_nulls
from ._vectors import matrix, sound

THRESHOLD, BLOCKS = 0.93, 8
#: Numbers (vectors times their length) in a block that is compared at a time, and the label size from which a cell goes by a second coordinate, by a third at twice that, and so on.
CELL, GRID = 1 << 19, 32_768
#: Cells of one vector over all blocks, at most (two per block in any case).
COPIES = 64


def rotation(size: int) -> np.ndarray:
    """A fixed random rotation."""
    return np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))[0]


def parts(size: int, blocks: int, threshold: float) -> list[tuple[slice, float]]:
    """(coordinates, squared distance) of each block, in proportion to its width."""
    edges = np.linspace(0, size, min(blocks, size) + 1).astype(int)
    return [(slice(a, b), (2 - 2 * threshold) * (b - a) / size + 1e-12) for a, b in itertools.pairwise(edges)]


def finest(blocks: int) -> int:
    """Most coordinates of a grid whose cells and later neighbours, over all blocks, are COPIES or less; one at least."""
    g = 1
    while blocks * (3 ** (g + 1) + 1) // 2 <= COPIES:
        g += 1
    return g


def _cells(threshold: float, blocks: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("embedding").offsets.to_numpy())
            grid = batch.column("grid").to_numpy()
            for size, g in {*zip(sizes.tolist(), grid.tolist(), strict=True)}:
                own = batch.take(pa.array(np.flatnonzero((sizes == size) & (grid == g))))
                x = matrix(own.column("embedding"))
                y = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ rotation(size)
                key, block, home = [], [], []
                for b, (cut, most) in enumerate(parts(size, blocks, threshold)):
                    at = np.floor(y[:, cut][:, :g] / np.sqrt(most)).astype(np.int64)
                    for step in itertools.product((-1, 0, 1), repeat=at.shape[1]):
                        if step >= (0,) * at.shape[1]:  # itself and the half of its neighbours that comes later
                            code = np.zeros(len(x), np.int64)
                            for k in range(at.shape[1]):
                                code = code * 65_537 + at[:, k] + step[k]
                            key.append(code)
                            block.append(b)
                            home.append(not any(step))
                n = len(key)
                item = pa.StructArray.from_arrays([pa.array(np.stack(key, 1).ravel()), pa.array(np.tile(np.array(block, np.int32), len(x))), pa.array(np.tile(np.array(home), len(x)))], ["code", "block", "home"])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(x) + 1, n, dtype=np.int32)), item)
                yield pa.RecordBatch.from_arrays([own.column("rep"), own.column("label"), pa.array(np.full(len(x), size, np.int32)), lists], ["rep", "label", "size", "cells"])

    return go


def linked(x: np.ndarray, home: np.ndarray, side: np.ndarray, cut: bool, block: int, threshold: float, blocks: int, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) that this cell and block are the first to offer."""
    norm = np.linalg.norm(x, axis=1)
    cuts = parts(x.shape[1], blocks, threshold)
    y = (x / norm[:, None]) @ rotation(x.shape[1])
    at, most = cuts[block]
    z = y[:, at]
    square = (z * z).sum(1)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, len(x), step):
        b = min(a + step, len(x))
        near = square[a:b, None] + square[None, a:] - 2 * (z[a:b] @ z[a:].T) <= most + 1e-9
        near &= home[a:b, None] | home[None, a:]
        if cut:
            near &= side[a:b, None] != side[None, a:]
        i, j = np.nonzero(near)
        keep = i < j
        i, j = i[keep] + a, j[keep] + a
        for lo in range(0, len(i), 1 << 16):
            p, q = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
            alike = np.einsum("ij,ij->i", x[p], x[q]) >= threshold * norm[p] * norm[q]
            p, q = p[alike], q[alike]
            gap = (y[p] - y[q]) ** 2
            first = np.ones(len(p), bool)
            for c, m in cuts[:block]:
                first &= gap[:, c].sum(1) > m
            # what rounding put on the other side here is this block's all the same
            first &= gap[:, at].sum(1) <= most
            left.append(p[first])
            right.append(q[first])
    return np.concatenate(left), np.concatenate(right)


def _compare(threshold: float, blocks: int):
    def go(t: pa.Table) -> pa.Table:
        keys = ["label", "size", "block", "code", "pair", "lo", "hi"]
        t = t.sort_by([(c, "ascending") for c in [*keys, "rep"]])
        cols = [t.column(c).to_numpy(zero_copy_only=False) for c in keys]
        ids, home, side, copies = (t.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "home", "side", "copies"))
        new = np.append(True, np.zeros(len(t) - 1, bool))
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        edges = np.append(np.flatnonzero(new), len(t))
        rep, links, a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if e - s < 2:
                continue
            x = matrix(t.column("embedding").slice(s, e - s))
            i, j = linked(x, home[s:e], side[s:e], bool(cols[4][s]), int(cols[2][s]), threshold, blocks)
            count = np.zeros(e - s, np.int64)
            np.add.at(count, i, copies[s + j])
            np.add.at(count, j, copies[s + i])
            k = np.flatnonzero(count)
            rep.append(ids[s + k])
            links.append(count[k])
            root = roots(e - s, i, j)
            k = np.flatnonzero(root != np.arange(e - s))
            a.append(ids[s + k])
            b.append(ids[s + root[k]])
        rep, links, a, b = map(np.concatenate, (rep, links, a, b))
        return pa.table({
            "rep": np.concatenate([rep, np.zeros(len(a), np.int64)]), "links": np.concatenate([links, np.zeros(len(a), np.int64)]),
            "a": np.concatenate([np.full(len(rep), -1), a]), "b": np.concatenate([np.full(len(rep), -1), b]), "edge": np.append(np.zeros(len(rep), bool), np.ones(len(a), bool)),
        })

    return go


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, blocks: int = BLOCKS) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies in (0, 1]")
    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("embedding"))
    able = sound("embedding") & F.col("label").isNotNull()
    same = [F.when(able, F.xxhash64("label", "embedding", F.lit(k))).alias(f"h{k}") for k in (1, 2)]
    rows = rows.select("vec_id", "label", "embedding", *same)
    alone = numbered(rows, "vec_id", F.struct("label", "h1", "h2", F.xxhash64("embedding")))
    rows = rows.withColumn("row", F.col("vec_id")) if alone is None else alone.withColumnRenamed("__row", "row")
    fit = rows.where("h1 is not null").groupBy("h1", "h2").agg(F.min("row").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    fit = stash(fit, "vectors")
    per_label = fit.groupBy("label").agg(F.count("*").alias("n"))
    grid = F.least(F.lit(finest(blocks)), 1 + F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / GRID)))).cast("int")
    cells = fit.join(per_label.select("label", grid.alias("grid")), "label").select("rep", "label", "embedding", "grid")
    cells = cells.mapInArrow(_cells(threshold, blocks), "rep long, label string, size int, cells array<struct<code:long,block:int,home:boolean>>")
    cells = cells.select("rep", "label", "size", F.explode("cells").alias("c")).select("rep", "label", "size", "c.*")
    key = ["label", "size", "block", "code"]
    sizes = stash(cells.groupBy(*key).agg(F.count("*").alias("m"), F.max("home").alias("lived")).where("m > 1 and lived").drop("lived"), "cells")
    work = in_blocks(cells.join(sizes, key), F.ceil(F.col("m") * F.col("size") / CELL)).select("rep", *key, "home", "side", "pair", "at.lo", "at.hi")
    # The vectors come last: until here a cell of a vector is a few numbers.
    work = work.join(fit.select("rep", "copies", "embedding"), "rep")
    packs = parts_for(sizes.agg(F.sum(F.col("m") * F.col("size"))).first()[0] or 0, CELL)
    # A cell that was cut has as many pieces as pairs of its blocks; a small one shares its task.
    piece = F.pmod(F.xxhash64(*key, "lo", "hi"), F.lit(4 * packs))
    found = stash(work.groupBy(piece.alias("piece")).applyInArrow(_compare(threshold, blocks), "rep long, links long, a long, b long, edge boolean"), "links")
    counts = found.where("not edge").groupBy("rep").agg(F.sum("links").alias("links"))
    tree = components(found.where("edge").select("a", "b"))
    per_class = fit.select("h1", "h2", "rep", "copies").join(counts, "rep", "left").join(tree.withColumnRenamed("node", "rep"), "rep", "left")
    top = F.coalesce("component", "rep", "row")
    out = rows.select("vec_id", "row", "h1", "h2").join(stash(per_class, "per-class"), ["h1", "h2"], "left")
    out = out.select("vec_id", "row", (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), top.alias("top"))
    kept = (F.col("row") == F.col("top")).alias("kept")
    if alone is None:
        out = out.select("vec_id", "n_links", F.col("top").alias("component_id"), kept)
    else:
        out = out.join(rows.select(F.col("row").alias("top"), F.col("vec_id").alias("component_id")), "top").select("vec_id", "n_links", "component_id", kept)
    return with_nulls(out, "vec_id", "component_id")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.93 within labels."""
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


QUERIES = {"op4_embedding_dedup": op4_embedding_dedup}
SQL = {
    "op4_embedding_dedup": """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.93
), r(node, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.node WHERE r.root < p.b),
top AS (SELECT node, min(root) AS component_id FROM r GROUP BY node), l AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT top.node AS vec_id, coalesce(l.n, 0) AS n_links, component_id, top.node = component_id AS kept FROM top LEFT JOIN l ON l.a = top.node
""",
}
