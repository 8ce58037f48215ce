"""N-gram Jaccard join by chosen paths: documents whose sets of word shingles overlap by ``threshold`` or more.

A run of the join walks a tree of shared tokens. At each node a set chooses tokens whose hash, fresh for the
run and the node, falls below 1 / (threshold * size), 1 / threshold tokens on average, and goes down the
branch of each. Two sets that are alike to the threshold share a chosen token, on average one at least, with a probability of 1 - 1/e
or more; at the last level, when every branch before is large, a run still brings them together with more than a third, and the
runs leave less than a pair in a million apart there. A branch of at most LEAF sets is compared by brute force; a larger one
splits again, and what is still large at the last level is compared in blocks of pairs, so nothing is capped. One branch in EARLY goes
first, a large one in blocks that are compared each in itself. Branches whose sets are all in one candidate component by then go no further: these sets meet anyway
when components are compared. A large branch with at most FEW sets outside one component is not split either: these few meet all blocks of the rest.

How it scales. Equal sets are one class and take part once. The first level's paths come from each text alone, in one pass;
what is shuffled is one number per path. Deeper paths are made only for the sets of branches that split. Branches with one set go at once, and of small branches with the same
sets one is compared. Brute force inside a branch looks
at small samples of the sets (one-permutation minima) and returns a spanning forest, never all pairs; the
forest's components hold all links, as the sample lets pass what is alike to within six deviations. Then each
component is compared exactly, once, with whole sets, again in blocks of bounded rows and words, counting links in place.

Cases. Words are runs of lower-case text between white space; fewer words than ``size`` make one shingle.
A null id comes after all others. Texts without words, null ones too, have an empty set, which links with nothing, not even its like.
Rows that share an id, null or not, stay rows of their own: those with one set count as copies, and one row of a component is kept. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._arrays import U, flat, mix
from ._graph import components, in_blocks, roots
from ._lean import lean, lean_group
from ._sieve import may, sieve
from ._spark import drop, numbered, parts_for, stash, table, texts, with_nulls
from ._words import blocks, shingles

SIZE, THRESHOLD = 5, 0.8
#: Share of pairs at the threshold that may stay apart.
MISS = 1e-6
LEVELS, LEAF, BINS = 3, 1000, 128
#: One in so many branches is compared before the others.
EARLY = 8
#: Sets of a large branch outside its largest component that are compared with all of it.
FEW = 250
#: Rows of branches, with their samples, in one task.
CELLS = 50_000
#: Sets, and shingles, compared in one piece of work.
PACK, TOKENS = 1500, 1 << 21
#: Of these, sets taken apart together.
SPAN = 200


def runs_for(miss: float, levels: int = LEVELS) -> int:
    """Runs after which a pair at the threshold has met with probability 1 - miss, even if it must meet at the last level.

    Such a pair shares threshold * size tokens of the larger set at least, so below each node it shares one chosen token on
    average at least; it stays apart if none of these leads to a meeting at the level below.
    """
    apart = 0.0
    for _ in range(levels):
        apart = np.exp(apart - 1)
    return int(np.ceil(np.log(miss) / np.log(apart)))


def limits(n: np.ndarray, threshold: float) -> np.ndarray:
    """Hash up to which a token of a set of n is chosen; a set of one token always chooses it."""
    bar = np.minimum(1 / (threshold * np.maximum(n, 1)), 1.0)
    return ((bar * (1 << 53)).astype(U) - U(1) << U(11)) | U(0x7FF)


def first_paths(row: np.ndarray, token: np.ndarray, n: np.ndarray, threshold: float, runs: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, path): the tokens that each row chooses at the root, in every run. Tokens are well mixed, so a run's hash is a product with its own odd number."""
    with np.errstate(over="ignore"):
        bar = limits(n, threshold)[row]
        at, path = [], []
        for odd in (mix(np.arange(1, runs + 1).astype(U) * U(0xA0761D6478BD642F)) | U(1)).reshape(-1, 1):
            hit = np.flatnonzero(token * odd <= bar)
            at.append(row[hit])
            path.append(mix(token[hit] + odd))
        return np.concatenate(at), np.concatenate(path)


def next_paths(token: np.ndarray, parents: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(index of the parent, path): the tokens that one set chooses below each of its paths."""
    with np.errstate(over="ignore"):
        bar = limits(np.array([len(token)]), threshold)
        k, of = np.nonzero(mix(token[None, :] ^ mix(parents)[:, None]) <= bar)
        return k, mix(parents[k] * U(31) + token[of])


def samples(row: np.ndarray, token: np.ndarray, rows: int, bins: int = BINS) -> np.ndarray:
    """Per row and bin, a byte of the least token hash in the bin (1 to 255), or 0 where the bin is empty."""
    with np.errstate(over="ignore"):
        h = mix(token ^ U(0x8EBC6AF09C88C6E3))
    slot = row * bins + (h >> U(57)).astype(np.int64)
    least = np.full(rows * bins, ~U(0))
    np.minimum.at(least, slot, h)
    byte = (least & U(0xFFFF)) % U(255) + U(1)
    return np.where(least == ~U(0), U(0), byte).astype(np.uint8).reshape(rows, bins)


def _below(size: int, threshold: float):
    """Paths one level down of (rep, component, z, parents)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for rep, component, z, parents in zip(*[batch.column(c).to_pylist() for c in ("rep", "component", "z")], batch.column("parents"), strict=True):
                text = np.frombuffer(expand(z), np.uint8)
                _, token = shingles(np.array([0, len(text)]), text, size)
                own = parents.values.to_numpy().view(U)
                for k in range(0, len(own), step := max(1, (1 << 20) // max(len(token), 1))):
                    _, path = next_paths(token, own[k : k + step], threshold)
                    path = np.unique(path).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(path), rep)), pa.array(np.full(len(path), component)), pa.array(path)], ["rep", "component", "path"])

    return go


def _sets(size: int, threshold: float, runs: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = flat(batch.column("text"))
            ids = batch.column("doc_id").to_numpy()
            for i, j, offsets, part in blocks(at, data):
                row, token = shingles(offsets, part, size)
                rows = j - i
                n = np.bincount(row, minlength=rows)
                with np.errstate(over="ignore"):
                    sums = np.zeros((2, rows), U)
                    for k, salt in enumerate((0x1B873593, 0xE6546B64)):
                        np.add.at(sums[k], row, mix(token + U(salt)))
                where, path = first_paths(row, token, n, threshold, runs)
                order = np.argsort(where, kind="stable")
                ends = np.searchsorted(where[order], np.arange(rows + 1)).astype(np.int32)
                sample = samples(row, token, rows)
                fixed = pa.array([x.tobytes() for x in sample], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[i:j]), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array(n.astype(np.int32)), fixed, pa.ListArray.from_arrays(pa.array(ends), pa.array(path[order].view(np.int64)))],
                    ["doc_id", "k1", "k2", "n", "sample", "paths"],
                )

    return go


def forest(link: np.ndarray) -> np.ndarray:
    """Least index reachable, from a square matrix of links."""
    label = np.arange(len(link))
    while True:
        low = np.where(link, label[None, :], len(label)).min(1, initial=len(label))
        new = np.minimum(label, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _alike(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs of samples that may be alike: agreements at least six deviations below what the threshold gives."""
    out = np.zeros((len(a), len(b)), bool)
    for k in range(len(a)):
        used = ((a[k] > 0) | (b > 0)).sum(1)
        same = ((a[k] == b) & (b > 0)).sum(1)
        out[k] = same >= threshold * used - 6 * np.sqrt(threshold * (1 - threshold) * used)
    return out


def _branch(threshold: float):
    def go(t: pa.Table) -> pa.Table:
        """Branches of one task, each compared inside itself; a spanning forest comes out."""
        t = t.sort_by("cell")
        cell = t.column("cell").to_numpy()
        ids = t.column("rep").to_numpy()
        n = t.column("n").to_numpy()
        sample = np.frombuffer(flat(t.column("sample"))[1], np.uint8).reshape(len(t), -1)
        a, b = [], []
        edges = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell))
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            order = i + np.argsort(ids[i:j], kind="stable")
            own, size = ids[order], n[order]
            link = _alike(sample[order], sample[order], threshold)
            link &= np.minimum(size[:, None], size[None, :]) >= threshold * np.maximum(size[:, None], size[None, :]) - 1e-9
            root = forest(link)
            k = np.flatnonzero(root != np.arange(len(root)))
            a.append(own[k])
            b.append(own[root[k]])
        # Families meet in many branches: what leaves the task is one forest over all of them, at most a row a set.
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
        names, k = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = roots(len(names), k[: len(a)], k[len(a) :])
        far = np.flatnonzero(root != np.arange(len(names)))
        return pa.table({"a": names[far], "b": names[root[far]]})

    return go


def _exact(size: int, threshold: float):
    def go(t: pa.Table) -> pa.Table:
        """Whole sets of the components in one piece of work; links are counted in place.

        side tells the block of a component that is cut: rows of one block meet only rows of the other, unless
        both blocks are one.
        """
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        t = t.sort_by([("cluster", "ascending"), ("rep", "ascending")])
        cluster, ids, weight, side, pair = (t.column(c).to_numpy() for c in ("cluster", "rep", "copies", "side", "pair"))
        z = t.column("z").combine_chunks()
        links, near = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        a, b = [], []

        def sets(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
            """(row, token) of rows i to j."""
            found = []
            for k in range(i, j, 50):
                raw = [expand(x.as_py()) for x in z.slice(k, min(50, j - k))]
                at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
                for first, _, offsets, part in blocks(at, np.frombuffer(b"".join(raw), np.uint8)):
                    row, token = shingles(offsets, part, size)
                    found.append(((row + (k + first)).astype(np.int32), token))
            return tuple(np.concatenate(c) for c in zip(*found, strict=True))

        edges = np.append(np.flatnonzero(np.append(True, cluster[1:] != cluster[:-1])), len(cluster))
        upto = 0
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if j > upto:  # a large component alone, small ones together: no more than one span is taken apart at a time
                row = token = None
                upto = int(edges[max(np.searchsorted(edges, i + SPAN, "right") - 1, np.searchsorted(edges, j))])
                row, token = sets(i, upto)
            lo, hi = np.searchsorted(row, (i, j))
            n = np.bincount(row[lo:hi] - i, minlength=j - i)
            both = shared(row[lo:hi] - i, token[lo:hi], j - i)
            link = np.zeros(both.shape, bool)
            for k in range(0, j - i, SPAN):
                some = slice(k, k + SPAN)
                union = n[some, None] + n[None, :] - both[some]
                link[some] = (both[some] >= threshold * union - 1e-9) & (n[some, None] > 0)
            np.fill_diagonal(link, False)
            if pair[i]:
                link &= side[i:j, None] != side[None, i:j]
            for k in range(0, j - i, SPAN):
                links[i + k : min(i + k + SPAN, j)] = link[k : k + SPAN] @ weight[i:j]
            near[i:j] = link.sum(1)
            root = forest(link)
            k = np.flatnonzero(root != np.arange(j - i))
            a.append(ids[i + k])
            b.append(ids[i + root[k]])
        k = sum(map(len, a))
        return pa.table({
            "rep": np.concatenate([ids, np.zeros(k, np.int64)]), "links": np.concatenate([links, np.zeros(k, np.int64)]), "texts": np.concatenate([near, np.zeros(k, np.int64)]),
            "a": pa.array(np.concatenate([np.full(len(ids), -1), *a])), "b": pa.array(np.concatenate([np.full(len(ids), -1), *b])), "edge": np.append(np.zeros(len(ids), bool), np.ones(k, bool)),
        })

    return go


def shared(row: np.ndarray, token: np.ndarray, rows: int, wide: int = 1024) -> np.ndarray:
    """Tokens that each two rows have in common: products of 0/1 blocks over the tokens in more than one row."""
    order = np.argsort(token, kind="stable")
    token, row = token[order], row[order]
    same = token[1:] == token[:-1]
    keep = np.append(same, False) | np.append(False, same) if len(token) else np.zeros(0, bool)
    token, row = token[keep], row[keep]
    name = np.cumsum(np.append(False, token[1:] != token[:-1]), dtype=np.int32)[: len(token)]
    out = np.zeros((rows, rows), np.float32)
    for lo in range(0, int(name[-1]) + 1 if len(name) else 0, wide):
        i, j = np.searchsorted(name, (lo, lo + wide))
        m = np.zeros((rows, wide), np.float32)
        m[row[i:j], name[i:j] - lo] = 1
        out += m @ m.T
    return out.astype(np.int32)


def celled(leaves: DataFrame, cells: DataFrame) -> DataFrame:
    """cells (rep, cell), and a row for each block that a set of leaves (rep, path, m) meets."""
    return cells.unionByName(in_blocks(leaves, F.ceil(F.col("m") / LEAF)).select("rep", F.xxhash64("path", "at").alias("cell")))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """One row per document.

    class_id: least id of the documents with the same set. n_links: other documents linked, copies included.
    n_linked_texts: classes linked. component_id: least id reachable by links. kept: the first row, by (id, text), of its component.
    """
    from .suffix_dedup import squeezed

    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies in (0, 1]")
    spark = docs.sparkSession
    docs = texts(docs, id_col, text_col)
    rows = numbered(docs)
    if rows is not None:  # from here to the end a row's number stands for its id
        docs = rows.select(F.col("__row").alias("doc_id"), "text")
    docs = docs.withColumn("text", F.lower("text"))
    found = stash(docs.mapInArrow(lean(_sets(size, threshold, runs_for(miss))), "doc_id long, k1 long, k2 long, n int, sample binary, paths array<long>"), "found")
    key = ["k1", "k2", "n"]
    sets = stash(found.select("doc_id", *key), "sets")
    reps = stash(sets.where("n > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "reps")
    more = sets.join(reps.where("copies > 1"), key).where("doc_id <> rep").select("doc_id")
    copies, some = sieve(more), found.where("n > 0")
    classes = some.where(may(copies, "doc_id")).join(more, "doc_id", "left_anti")
    classes = stash((classes if copies is None else classes.unionByName(some.where(~may(copies, "doc_id")))).withColumnRenamed("doc_id", "rep").select("rep", "n", "sample", "paths"), "classes")
    drop(found)

    def branches(steps: DataFrame, last: bool) -> tuple[DataFrame, DataFrame]:
        """(leaves, large) of steps (rep, component, path): rows (rep, component, path, m) of branches that hold several components, small ones and, unless last, those that split."""
        same = [F.bit_xor(F.xxhash64("rep", F.lit(k))).alias(f"s{k}") for k in (1, 2)]
        sizes = steps.groupBy("path").agg(F.count("*").alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi"), *same).where("lo <> hi")
        # Branches of the same sets are compared once; a large one that still splits does so in each run anew.
        again = F.lit(0).cast("long") if last else F.when(F.col("m") > LEAF, F.col("path")).otherwise(0)
        sizes = stash(sizes.groupBy("m", "s1", "s2", again.alias("again")).agg(F.min("path").alias("path")).select("path", "m"), "sizes")
        company = stash(steps.where(may(sieve(sizes.select("path")), "path")).join(sizes, "path"), "company")
        written.extend([sizes, company])
        return (company, company.limit(0)) if last else (company.where(F.col("m") <= LEAF), company.where(F.col("m") > LEAF))

    def starred(large: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(cells, rest) of large branches (rep, component, path, m): rows (rep, cell) of those with few sets outside one component, and the other branches."""
        held = large.groupBy("path", "component").agg(F.count("*").alias("n")).groupBy("path").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all"))
        main = stash(held.where(F.col("all") - F.col("top.n") <= FEW).select("path", F.col("top.component").alias("main")), "main")
        blocks = F.ceil(F.col("m") / LEAF).cast("int")
        at = F.when(F.col("component") == F.col("main"), F.array(F.pmod(F.xxhash64("rep"), blocks).cast("int"))).otherwise(F.sequence(F.lit(0), blocks - 1))
        cells = stash(large.join(main, "path").select("rep", "path", F.explode(at).alias("block")).select("rep", F.xxhash64("path", F.lit(-1), "block").alias("cell")), "cells")
        written.extend([main, cells])
        return cells, large.join(main, "path", "left_anti")

    def below(large: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(leaves, cells) under large branches and of them; what is too large at the last level is compared in blocks."""
        leaves, cells = large.limit(0), classes.select("rep", F.col("rep").alias("cell")).limit(0)
        for level in range(1, LEVELS + 1):
            if large.isEmpty():
                break
            star, large = starred(large)
            cells = cells.unionByName(star)
            if level == LEVELS or large.isEmpty():
                break
            parents = stash(large.groupBy("rep", "component").agg(F.collect_list("path").alias("parents")), "parents")
            own = squeezed(docs, sieve(parents.select("rep"))).withColumnRenamed("doc_id", "rep").join(parents, "rep")
            steps = stash(own.mapInArrow(lean(_below(size, threshold)), "rep long, component long, path long"), "steps")
            written.extend([parents, steps])
            found, large = branches(steps, level == LEVELS - 1)
            leaves = leaves.unionByName(found)
        return leaves, cells

    def compared(leaves: DataFrame, cells: DataFrame) -> DataFrame:
        """(a, b): a forest of the candidate links inside leaves (rep, component, path, m) and cells (rep, cell)."""
        rows = (leaves.agg(F.sum(F.ceil(F.col("m") / LEAF))).first()[0] or 0) + cells.count()  # a row for each block that a set meets
        cells = celled(leaves, cells).join(classes.select("rep", "n", "sample"), "rep")
        found = cells.groupBy(F.pmod("cell", F.lit(parts_for(rows, CELLS))).alias("pack")).applyInArrow(lean_group(_branch(threshold)), "a long, b long")
        return stash(found.distinct(), "close")

    written: list[DataFrame] = []
    early = F.pmod(F.xxhash64("path"), F.lit(EARLY)) == 0
    steps = lambda rows: rows.select("rep", "component", F.explode("paths").alias("path"))
    leaves, first = branches(steps(classes.withColumn("component", F.col("rep"))).where(early), False)
    block = F.pmod(F.xxhash64("rep", "path"), F.ceil(F.col("m") / LEAF))
    close = compared(leaves, first.select("rep", F.xxhash64("path", F.lit(-2), block).alias("cell")))
    # Sets that these branches bring into one component meet there, whole, in the end; a branch goes on only if it holds several components.
    label = components(close).select(F.col("node").alias("rep"), "component")
    named = lambda rows: rows.join(label, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    leaves, large = branches(steps(named(classes)).where(~early).unionByName(named(first.select("rep", "path"))), False)
    under, cells = below(large)
    close = close.unionByName(compared(leaves.unionByName(under), cells))
    drop(*written)
    cluster = components(close)

    members = cluster.select(F.col("node").alias("rep"), F.col("component").alias("cluster")).join(reps.select("rep", "copies", "n"), "rep")
    members = stash(members, "members")
    sizes = stash(members.groupBy("cluster").agg(F.count("*").alias("m"), F.sum("n").alias("tokens")), "clusters")
    work = in_blocks(members.join(sizes, "cluster"), F.ceil(F.greatest(F.col("m") / PACK, F.col("tokens") / TOKENS)))
    whole = sizes.agg(F.sum("m"), F.sum("tokens")).first()
    packs = max(parts_for(whole[0] or 0, PACK), parts_for(whole[1] or 0, TOKENS))
    piece = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(packs))).otherwise(F.xxhash64("cluster", "at"))
    work = work.select("rep", "cluster", "copies", "side", "pair", piece.alias("piece"))
    work = squeezed(docs, sieve(members.select("rep"))).withColumnRenamed("doc_id", "rep").join(work, "rep")
    exact = stash(work.groupBy("piece").applyInArrow(lean_group(_exact(size, threshold)), "rep long, links long, texts long, a long, b long, edge boolean"), "links")
    counts = exact.where("not edge").groupBy("rep").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    tree = components(exact.where("edge").select("a", "b"))

    per_class = reps.join(counts, "rep", "left").join(tree.withColumnRenamed("node", "rep"), "rep", "left")
    per_class = stash(per_class, "per-class")
    drop(classes, reps, members, sizes, exact)
    out = sets.join(per_class, ["k1", "k2", "n"], "left")
    top = F.coalesce("component", "rep", "doc_id")
    out = out.select(
        "doc_id", F.coalesce("rep", "doc_id").alias("class_id"), (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("texts", F.lit(0)).alias("n_linked_texts"), top.alias("component_id"), (F.col("doc_id") == top).alias("kept"),
    )
    if rows is not None:
        columns = out.columns
        for c in ("doc_id", "class_id", "component_id"):
            out = out.join(rows.select(F.col("__row").alias(c), F.col("doc_id").alias("__id")), c).drop(c).withColumnRenamed("__id", c)
        out = out.select(*columns)
    return with_nulls(out, "doc_id", "class_id", "component_id")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, classes and components of all documents at 0.8 over five words."""
    return jaccard_join(table(spark, sf_dir, "documents"))


QUERIES = {"op3_ngram_jaccard_join": op3_ngram_jaccard_join}
SQL = {
    "op3_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\t-\r ]+'), lambda x: x <> '') AS ws FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS s FROM w
), k AS (SELECT doc_id, s, len(s) AS n, md5(array_to_string(list_sort(s), '|')) AS k FROM g),
c AS (SELECT k, n, min(doc_id) AS rep, count(*) AS copies, arg_min(s, doc_id) AS s FROM k WHERE n > 0 GROUP BY k, n),
t AS MATERIALIZED (SELECT rep, n, unnest(s) AS tok FROM c),
p AS MATERIALIZED (
  SELECT x.rep AS a, y.rep AS b FROM t x JOIN t y ON x.tok = y.tok AND x.rep <> y.rep
  GROUP BY x.rep, y.rep, x.n, y.n HAVING count(*) >= 0.8 * (x.n + y.n - count(*)) - 1e-9
), r(node, root) AS (SELECT rep, rep FROM c UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.node WHERE r.root < p.b),
top AS (SELECT node, min(root) AS component FROM r GROUP BY node),
l AS (SELECT p.a AS rep, sum(c.copies) AS links, count(*) AS texts FROM p JOIN c ON c.rep = p.b GROUP BY p.a)
SELECT k.doc_id, coalesce(c.rep, k.doc_id) AS class_id, CAST(coalesce(c.copies, 1) - 1 + coalesce(l.links, 0) AS BIGINT) AS n_links,
  CAST(coalesce(l.texts, 0) AS BIGINT) AS n_linked_texts, coalesce(top.component, k.doc_id) AS component_id,
  k.doc_id = coalesce(top.component, k.doc_id) AS kept
FROM k LEFT JOIN c ON c.k = k.k AND c.n = k.n AND k.n > 0 LEFT JOIN l ON l.rep = c.rep LEFT JOIN top ON top.node = c.rep
""",
}
