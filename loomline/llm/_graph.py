"""Connected components as joins and grouped minima."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import drop, stash


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable from each node of ``edges``.

    Labels fall to the least label of the neighbours, then each node takes its label's label; both steps
    are joins and grouped minima over narrow rows, and each round is written out so that lineage stays short.
    Paths shorten by more than half a round.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = stash(both.unionAll(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = written = stash(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("c")).select("u", "c"), "labels")
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), "c"), "v").groupBy("u").agg(F.min("c").alias("m"))
        step = labels.join(near, "u").select("u", F.least("c", "m").alias("m"), "c")
        jump = labels.select(F.col("u").alias("m"), F.col("c").alias("j"))
        after = stash(step.join(jump, "m").select("u", F.least("m", "j").alias("c"), (F.least("m", "j") < F.col("c")).alias("moved")), "labels")
        drop(written)
        labels, written = after.select("u", "c"), after
        if after.where("moved").isEmpty():
            drop(both)
            return labels.select(F.col("u").alias("node"), F.col("c").alias("component"))


def in_blocks(members: DataFrame, blocks: Column, by: str = "rep") -> DataFrame:
    """Rows dealt to pieces of work, for all pairs inside each group.

    A group is cut into ``blocks`` by a hash of ``by``, and each two blocks meet once, at (lo, hi);
    side is the row's block, and ``pair`` tells that two different blocks meet, so that only rows of different sides count.
    """
    blocks = F.greatest(blocks, F.lit(1)).cast("int")
    with_block = members.withColumn("blocks", blocks).withColumn("side", F.pmod(F.xxhash64(by), blocks).cast("int"))
    pairs = F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, "side").alias("lo"), F.greatest(k, "side").alias("hi")))
    )
    return with_block.withColumn("at", F.explode(pairs)).withColumn("pair", F.col("at.lo") != F.col("at.hi"))


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least index reachable from each of n by the links i-j."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            return label
        label = low
