"""The archive: which sessions to ingest, and tables to which ingests are appended.

A table is a Parquet folder <table>/ingest=<n>/bucket=<b>, sessions dealt to buckets by a hash of their id; a list of (session, bucket) is written last and
commits its ingest. Of each session the latest committed ingest counts, so an ingest replaces whole sessions without rewriting anything, and what a lost
attempt left behind is never seen. Readers ask the list first which parts hold a current session: parts whose sessions have all been replaced are not opened, and
for a few sessions only their buckets are. ``compact`` brings what is left of the older ingests into one. Sessions whose transcripts are gone stay.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, MapType, StructField, StructType

from loomline.functions import text as T
from loomline.operators import shell

INGESTS, STAGE, COMMANDS, RESERVED = "ingests", "_stage", "commands", "reserved"
#: Parts of a table's ingest, and tables written at once.
BUCKETS, AT_ONCE = 16, 4


def to_ingest(units: DataFrame, sessions: DataFrame, markers: DataFrame, versions: dict[str, int]) -> DataFrame:
    """units (session_id, modified, size) that are new, changed, or lack an extraction of the present version, with the reason."""
    have = sessions.select("session_id", F.col("modified").alias("had_modified"), F.col("size").alias("had_size"))
    done = markers.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "version"))).alias("done"))
    rows = units.join(have, "session_id", "left").join(done, "session_id", "left")
    behind = F.lit(False)
    for name, version in versions.items():
        behind = behind | (F.coalesce(F.try_element_at("done", F.lit(name)), F.lit(-1)) < version)
    changed = (F.col("modified") != F.col("had_modified")) | (F.col("size") != F.col("had_size"))
    why = F.when(F.col("had_size").isNull() & F.col("had_modified").isNull(), "new").when(changed, "changed").when(behind, "outdated")
    return rows.withColumn("reason", why).where("reason IS NOT NULL").select("session_id", "modified", "size", "reason")


def ingest_summary(units: DataFrame, gated: DataFrame, health: DataFrame) -> DataFrame:
    """One row: new, updated, skipped, degraded, and failed: sessions that were to be ingested but gave no line that could be read."""
    rows = units.select("session_id").join(gated.select("session_id", "reason"), "session_id", "left").join(health.select("session_id", "parse_status"), "session_id", "left")
    due, read = F.col("reason").isNotNull(), F.col("parse_status").isNotNull()
    return rows.agg(
        F.count_if((F.col("reason") == "new") & read).alias("new"), F.count_if(F.col("reason").isin("changed", "outdated") & read).alias("updated"), F.count_if(~due).alias("skipped"),
        F.count_if(due & (F.col("parse_status") == "degraded")).alias("degraded"), F.count_if(due & ~read).alias("failed"),
    )


def quarantined(lines: DataFrame) -> DataFrame:
    """(session_id, stream, line_no, raw) of lines that are no JSON object, as they stand."""
    return lines.where("v IS NULL").select("session_id", "stream", "line_no", F.left("raw", F.lit(200)).alias("raw"))


def session_rows(stats: DataFrame, health: DataFrame, units: DataFrame, costs: DataFrame) -> DataFrame:
    """Archive rows: no start is null, as the file's change time stands in."""
    out = units.join(stats, "session_id", "left").join(health, "session_id", "left").join(costs, "session_id", "left")
    return out.withColumn("started_at", F.coalesce("started_at", "modified")).withColumn("ended_at", F.coalesce("ended_at", "modified")).withColumn("parse_status", F.coalesce("parse_status", F.lit("degraded")))


def unsure_if_unsupported(rows: DataFrame, health: DataFrame) -> DataFrame:
    """rows with a confidence: heuristic where the session's version is not a supported one."""
    known = health.select("session_id", T.supported_version("version").alias("known"))
    return rows.join(known, "session_id", "left").withColumn("confidence", F.when(F.col("known"), F.col("confidence")).otherwise("heuristic")).drop("known")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def committed(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the ingests whose list is complete, in order; what a lost attempt left of a list has no mark of success."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{INGESTS}")
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        return []
    names = [x.getPath().getName() for x in files.listStatus(where)]
    return sorted(int(n.removeprefix("ingest=")) for n in names if n.startswith("ingest=") and exists(spark, f"{path}/{INGESTS}/{n}/_SUCCESS"))


def _reserved(spark: SparkSession, path: str) -> dict[str, int]:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{STAGE}/{RESERVED}")
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in files.listStatus(where)] if files.exists(where) else []
    return {owner: int(n) for n, _, owner in (name.partition("-") for name in names)}


def next_ingest(spark: SparkSession, path: str) -> int:
    """A number above all that are committed or reserved."""
    return max([*committed(spark, path), *_reserved(spark, path).values()], default=-1) + 1


def reserve(spark: SparkSession, path: str, owner: str) -> int:
    """The ingest number of a batch that may be tried again: whoever asks for one owner again gets the same, until a later batch has its own."""
    held = _reserved(spark, path)
    if owner not in held:
        held[owner] = next_ingest(spark, path)
        done = committed(spark, path)
        for other, n in held.items():
            if n in done:
                _delete(spark, f"{path}/{STAGE}/{RESERVED}/{n}-{other}")
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{STAGE}/{RESERVED}/{held[owner]}-{owner}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True).close()
    return held[owner]


def bucket_of(session: str = "session_id") -> F.Column:
    return F.pmod(F.xxhash64(F.col(session).cast("string")), F.lit(BUCKETS)).cast("int")


def append(path: str, ingest: int, ids: DataFrame, tables: dict[str, DataFrame]) -> None:
    """Write the rows of one ingest, several tables at a time, and last of all its sessions ``ids``; done twice with one number it gives the same."""

    def write(name: str, rows: DataFrame) -> None:
        _describe(rows, f"{path}/{name}")
        rows.withColumn("bucket", bucket_of()).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}/ingest={ingest}")

    with ThreadPoolExecutor(AT_ONCE) as pool:
        for done in [pool.submit(write, name, rows) for name, rows in tables.items()]:
            done.result()
    ids.select("session_id").distinct().withColumn("bucket", bucket_of()).write.mode("overwrite").parquet(f"{path}/{INGESTS}/ingest={ingest}")


def _describe(rows: DataFrame, at: str) -> None:
    """Keep a table's columns beside it: an ingest may bring no rows, and then no file to tell them."""
    spark = rows.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_columns.json")
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(rows.schema.json().encode()))
    out.close()


def _columns(spark: SparkSession, at: str) -> StructType:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_columns.json")
    told = spark._jvm.org.apache.commons.io.IOUtils.toString(where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where), "UTF-8")
    return StructType.fromJson(json.loads(told))


def latest(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, bucket, ingest): where each session's current rows lie."""
    done = committed(spark, path)
    if not done:
        raise LookupError(f"nothing has been ingested at {path}")
    lists = spark.read.option("basePath", f"{path}/{INGESTS}").parquet(*[f"{path}/{INGESTS}/ingest={n}" for n in done])
    return lists.groupBy("session_id", "bucket").agg(F.max("ingest").alias("ingest"))


def current(spark: SparkSession, path: str, name: str, sessions: DataFrame | None = None) -> DataFrame:
    """A table's rows of each session's latest committed ingest, of all sessions or of the few given; only parts that hold any are read."""
    where = latest(spark, path)
    if sessions is not None:
        where = where.join(sessions.select("session_id").distinct(), "session_id", "left_semi")
    held: dict[int, list[int]] = {}
    for r in where.select("ingest", "bucket").distinct().collect():  # BUCKETS for each ingest at most
        held.setdefault(r["ingest"], []).append(r["bucket"])
    parts = StructType([*_columns(spark, f"{path}/{name}").fields, StructField("ingest", IntegerType()), StructField("bucket", IntegerType())])
    wanted = F.lit(False)
    for ingest, buckets in held.items():
        wanted = wanted | ((F.col("ingest") == ingest) & F.col("bucket").isin(buckets))
    rows = spark.read.schema(parts).option("basePath", f"{path}/{name}").parquet(*[f"{path}/{name}/ingest={n}" for n in held] or [f"{path}/{name}"]).where(wanted)
    return rows.join(where.select("session_id", "ingest"), ["session_id", "ingest"], "left_semi").drop("ingest", "bucket")


def compact(spark: SparkSession, path: str, names: list[str], to: str | None = None, keep: int = 1) -> None:
    """Bring together what is current.

    Into a new archive at ``to``, as its first ingest; or, without it, in place: what all ingests but the latest ``keep`` still hold becomes one more ingest,
    and these go once that is committed. No later ingest has their sessions, so its higher number hides nothing; nothing may be ingested meanwhile.
    """
    if to is not None:
        append(to, 0, latest(spark, path), {name: current(spark, path, name) for name in names})
        return
    done = committed(spark, path)
    cold = done[: max(0, len(done) - keep)]
    if len(cold) < 2:
        return
    ids = latest(spark, path).where(F.col("ingest").isin(cold)).select("session_id")
    append(path, done[-1] + 1, ids, {name: current(spark, path, name, ids) for name in names})
    for n in cold:
        for name in [INGESTS, *names]:
            _delete(spark, f"{path}/{name}/ingest={n}")


def staged(rows: DataFrame, path: str, ingest: int, name: str) -> DataFrame:
    """rows, written below the archive and read again: what several tables are made from is made once, and a lost executor costs no part of it."""
    at = f"{path}/{STAGE}/{ingest}/{name}"
    rows.write.mode("overwrite").parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)


def unstage(spark: SparkSession, path: str, ingest: int) -> None:
    _delete(spark, f"{path}/{STAGE}/{ingest}")


def known_commands(spark: SparkSession, path: str, ingest: int, commands: DataFrame) -> DataFrame:
    """Segments of these commands: those of earlier ingests are looked up, the others are taken apart and kept for later ones."""
    asked = commands.distinct()
    have, new = None, asked
    if earlier := [n for n in committed(spark, path) if exists(spark, f"{path}/{COMMANDS}/ingest={n}")]:
        have = spark.read.parquet(*[f"{path}/{COMMANDS}/ingest={n}" for n in earlier]).join(asked, "command", "left_semi")
        new = asked.join(have.select("command").distinct(), "command", "left_anti")
    own = shell.segments(new)
    # A command without segments is kept as well, so that it is not taken apart again.
    own = new.join(own, "command", "left")
    own.write.mode("overwrite").parquet(f"{path}/{COMMANDS}/ingest={ingest}")
    own = spark.read.schema(own.schema).parquet(f"{path}/{COMMANDS}/ingest={ingest}")
    every = own if have is None else own.unionByName(have)
    return every.where("seg_no IS NOT NULL")


def sessions_since(sessions: DataFrame, start) -> DataFrame:
    return sessions.where(F.col("started_at") >= F.lit(start)).orderBy("started_at", "session_id")


def source_gone(sessions: DataFrame, units: DataFrame) -> DataFrame:
    """Archived sessions without a transcript any more."""
    return sessions.join(units.select("session_id"), "session_id", "left_anti")


def coverage(sessions: DataFrame, markers: DataFrame) -> DataFrame:
    """One row: sessions, those with extracted facts, and their tool output."""
    done = markers.where("name = 'facts'").groupBy("session_id").agg(F.max("tool_output_tokens").alias("tool_output_tokens"))
    return sessions.select("session_id").join(done, "session_id", "left").agg(F.count("*").alias("sessions"), F.count("tool_output_tokens").alias("covered"), F.coalesce(F.sum("tool_output_tokens"), F.lit(0)).alias("tool_output_tokens"))


def snapshot(rows: DataFrame, without: list[str] = ("parsed_at",)) -> tuple[int, int]:
    """(rows, hash of all content in any order), without volatile columns: equal snapshots mean equal tables."""
    kept = [F.array_sort(F.map_entries(c)) if isinstance(rows.schema[c].dataType, MapType) else F.col(c) for c in sorted(rows.columns) if c not in without]
    out = rows.agg(F.count("*"), F.sum(F.xxhash64(*kept).cast("decimal(38,0)"))).first()
    return out[0], int(out[1] or 0)
