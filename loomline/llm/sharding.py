"""Sharding by sampled splitters: shards of nearly equal bytes, equal texts together.

Records are ordered by (digest of the text, id). A sample of keys, drawn with probability in proportion to
size, gives quantile boundaries; records are range-partitioned by them, and a range that comes out overfull in
rows or bytes gets further boundaries of its own, until none is or it cannot be cut. Each range knows its exact bytes and
rows, so every record knows what lies before it in the whole order. The sample decides only how the work is
spread; the result is exact and the same on any cluster.

The law. A group of equal texts is never parted, unless it is larger than a whole shard's share; such a group is cut into as many
pieces as shares it would fill, by a digest of the id. Groups over 1/PARTS of a share, and these pieces, are placed largest first, each
on the shard that holds least so far; the others follow in order of their digest and fill what room is left in the shards, in proportion.
So no shard departs from its share by much more than one group's size, where groups allow it.

How it scales. Only (id, size, checksum, digest) moves. Small groups lie whole in a range, large ones spread over ranges. Windows run inside
ranges, over narrow rows. The driver sees a row for each range and twenty sampled keys, at most RANGES ranges to begin with, and the large groups,
at most PARTS per shard.

Cases. A null id comes after all others; null text counts as empty, size 1. Rows that share id and text are neighbours in the order. An empty
table gives no rows; extra columns are not read. Ties cannot matter: equal keys are equal rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._spark import parts_for, stash, table, texts, with_nulls

SHARDS = 8
#: Rows of a range, ranges to begin with at most, keys sampled for each, and parts of a shard's share from which a group is placed by its size.
RANGE, RANGES, DRAWS, PARTS = 50_000, 4096, 20, 512


def draw(rows: DataFrame, key: str, size: str, total: int, wanted: int) -> list:
    """About ``wanted`` keys, each drawn in proportion to its row's size by a hash of the key; in order."""
    chance = F.least(F.lit(1.0), F.col(size) * (wanted / max(total, 1)))
    hit = F.pmod(F.xxhash64(key), F.lit(1 << 30)) < chance * (1 << 30)
    return sorted(r[0] for r in rows.where(hit).select(key).collect())


def quantiles(keys: list, ranges: int) -> list:
    """ranges - 1 boundaries at equal steps through sampled keys."""
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def _place(bounds: np.ndarray):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.array(batch.column("key").to_pylist(), "S48")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.searchsorted(bounds, keys, "right").astype(np.int64))], [*batch.schema.names, "range"])

    return go


def ranged(rows: DataFrame, ranges: int, total: int) -> tuple[DataFrame, list]:
    """rows (key, size, small, ...) with their range, and (range, n, bytes, small) of each; no range holds over three times its part of rows or bytes, unless it cannot be cut."""
    bounds = quantiles(draw(rows, "key", "size", total, DRAWS * ranges), ranges)
    schema = StructType([*rows.schema.fields, StructField("range", LongType())])
    while True:
        placed = rows.mapInArrow(_place(np.array(bounds, "S48")), schema)
        count = placed.groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.sum("small").alias("small")).orderBy("range").collect()
        n = sum(r["n"] for r in count)
        over = {r["range"]: max(r["n"] * ranges / max(n, 1), r["bytes"] * ranges / max(total, 1)) for r in count}
        over = {k: int(np.ceil(v)) for k, v in over.items() if v > 3}
        if not over:
            return placed, count
        bytes_of = {r["range"]: r["bytes"] for r in count}
        rates = rows.sparkSession.createDataFrame([(k, DRAWS * v / bytes_of[k]) for k, v in over.items()], "range long, rate double")
        hit = F.pmod(F.xxhash64("key", F.lit(len(bounds))), F.lit(1 << 30)) < F.least(F.lit(1.0), F.col("size") * F.col("rate")) * (1 << 30)
        drawn: dict[int, list] = {}
        for r in placed.join(F.broadcast(rates), "range").where(hit).select("range", "key").collect():  # a rate for each overfull range
            drawn.setdefault(r["range"], []).append(r["key"])
        more = {b for k, keys in drawn.items() for b in quantiles(sorted(keys), over[k])} - set(bounds)
        if not more:
            return placed, count
        bounds = sorted({*bounds, *more})


def least_loaded(sizes: list[int], shards: int) -> tuple[list[int], list[int]]:
    """(shard of each, bytes per shard): sizes in the order given, each to the shard that holds least, the first of equals."""
    loads, at = [0] * shards, []
    for size in sizes:
        at.append(loads.index(min(loads)))
        loads[at[-1]] += size
    return at, loads


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) by the law ``bytes``."""
    spark = docs.sparkSession
    docs = texts(docs, id_col, text_col)
    rows = stash(docs.select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32("text").alias("text_crc32"), F.md5("text").alias("k")), "rows")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()

    whole = F.lit(total).cast("decimal(38,0)")
    large = rows.groupBy("k").agg(F.sum("size").cast("decimal(38,0)").alias("s")).where(F.col("s") * (shards * PARTS) > whole)
    shares = F.call_function("div", F.col("s") * shards + whole - 1, whole)  # rounded up; a quotient of decimals keeps six places only
    large = large.select("k", F.when(F.col("s") * shards > whole, shares).otherwise(1).cast("long").alias("pieces"))
    own = F.conv(F.substring(F.md5(F.coalesce(F.nullif("doc_id", F.lit((1 << 63) - 1)).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
    rows = rows.join(F.broadcast(large), "k", "left").withColumn("piece", F.pmod(own, F.col("pieces")))  # at most shards * PARTS groups
    items = rows.where("piece is not null").groupBy("k", "piece").agg(F.sum("size").alias("s")).orderBy(F.desc("s"), "k", "piece").collect()
    at, loads = least_loaded([r["s"] for r in items], shards)
    placed = spark.createDataFrame([(r["k"], r["piece"], a) for r, a in zip(items, at, strict=True)], "k string, piece long, home int")
    rows = rows.join(F.broadcast(placed), ["k", "piece"], "left")
    order = F.lpad(F.hex(F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    rows = rows.select("doc_id", "size", "text_crc32", "k", "home", F.when(F.col("home").isNull(), F.col("size")).otherwise(0).alias("small"), order.alias("order"), F.when(F.col("home").isNull(), F.col("k")).otherwise(F.concat("k", order)).alias("key"))
    ranges = min(RANGES, max(parts_for(n, RANGE), min(shards, max(n, 1))))
    placed, count = ranged(rows, ranges, total)

    before = np.cumsum([0, *[r["small"] for r in count]])
    offsets = spark.createDataFrame([(r["range"], int(b)) for r, b in zip(count, before[:-1], strict=True)], "range long, ahead long")
    small, room = int(before[-1]), np.cumsum([max(0, total - shards * x) for x in loads]).tolist()  # room in shares of a shard
    group = Window.partitionBy("range", "k")
    upto = Window.partitionBy("range").orderBy("k")  # with all rows of the same k
    local = placed.join(F.broadcast(offsets), "range").withColumn("begin", F.col("ahead") + F.sum("small").over(upto) - F.sum("small").over(group))  # a row per range
    at = F.col("begin").cast("decimal(38,0)") * F.lit(room[-1]).cast("decimal(20,0)")
    beyond = sum((at >= F.lit(str(r * small)).cast("decimal(38,0)")).cast("int") for r in room[:-1]) if shards > 1 else F.lit(0)  # past 1.1 GB beyond a long
    local = local.withColumn("shard", F.coalesce("home", beyond).cast("int"))
    number = F.row_number().over(Window.partitionBy("range", "shard").orderBy("k", "order")) - 1
    local = stash(local.select("doc_id", "size", "text_crc32", "range", "shard", number.cast("long").alias("number")), "sharded")
    first = local.groupBy("range", "shard").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    first = first.select("range", "shard", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("first"))
    out = local.join(first, ["range", "shard"])
    out = out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("number")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    return with_nulls(out)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of nearly equal bytes."""
    return shard(table(spark, sf_dir, "documents"))


QUERIES = {"op2_sharding": op2_sharding}
SQL = {
    "op2_sharding": r"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab),
d AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (
  SELECT doc_id, text, CAST(xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(h), 2), lambda i: CAST('0x' || h[i:i+1] AS BIGINT))),
    lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1])), 4294967295) AS BIGINT) AS crc FROM d, t
), r AS MATERIALIZED (SELECT doc_id, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS size, crc, md5(text) AS k FROM c),
tot AS (SELECT sum(size) AS total FROM r),
big AS (
  SELECT k, CASE WHEN s * 8 > total THEN (s * 8 + total - 1) // total ELSE 1 END AS pieces FROM (SELECT k, sum(size) AS s FROM r GROUP BY k), tot WHERE s * 4096 > total
), m AS MATERIALIZED (
  SELECT r.*, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % pieces AS piece FROM r LEFT JOIN big USING (k)
), items AS MATERIALIZED (
  SELECT k, piece, CAST(sum(size) AS BIGINT) AS s, row_number() OVER (ORDER BY sum(size) DESC, k, piece) AS no FROM m WHERE piece IS NOT NULL GROUP BY k, piece
), lpt(no, loads, place) AS (
  SELECT CAST(0 AS BIGINT), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], CAST(0 AS BIGINT)
  UNION ALL
  SELECT i.no, list_transform(loads, lambda x, j: CASE WHEN j = list_position(loads, list_min(loads)) THEN x + i.s ELSE x END), CAST(list_position(loads, list_min(loads)) AS BIGINT)
  FROM lpt JOIN items i ON i.no = lpt.no + 1
), room AS (
  SELECT list_transform(range(1, 9), lambda n: list_sum(list_transform(loads[1:n], lambda x: greatest(0, total - 8 * x)))) AS upto FROM lpt, tot ORDER BY no DESC LIMIT 1
), small AS (SELECT CAST(coalesce(sum(size), 0) AS HUGEINT) AS bytes FROM m WHERE piece IS NULL),
b AS (SELECT k, CAST(sum(size) OVER (ORDER BY k) - size AS HUGEINT) AS begin FROM (SELECT k, sum(size) AS size FROM m WHERE piece IS NULL GROUP BY k)),
s AS (
  SELECT m.*, CAST(CASE WHEN m.piece IS NULL THEN len(list_filter(upto[1:7], lambda x: begin * upto[8] >= x * small.bytes)) ELSE lpt.place - 1 END AS INTEGER) AS shard
  FROM m CROSS JOIN room CROSS JOIN small LEFT JOIN b ON m.piece IS NULL AND b.k = m.k LEFT JOIN items i ON i.k = m.k AND i.piece = m.piece LEFT JOIN lpt ON lpt.no = i.no
)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY k, doc_id NULLS LAST) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
""",
}
