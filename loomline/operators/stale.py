"""Transcript events to the reads, changes and compactions from which stale copies follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions import text as T

from . import shell
from .attribution import EDITORS
from .joins import spread
from .windows import SIDE

OPS = ["session_id", *SIDE, "idx", "seq", "op", "path", "tokens", "partial", "exact", "tool"]


def stale_ops(events: DataFrame, results: DataFrame, roots: DataFrame | None = None, segs: DataFrame | None = None) -> DataFrame:
    """Rows for windows.stale_windows: (session_id, window, idx, seq, op, path, tokens, partial, exact, tool).

    Only calls whose result is there and no error count. Paths are joined to cwd and resolved; with roots (session_id, root) they are given
    relative to the root, and what lies outside is left out. A shell command reads first and changes then; its output goes in even shares to the
    files it reads as a whole. What a git command may rewrite is a change without a path.
    """
    field = lambda p: F.get_json_object("tool_input", f"$.{p}")
    if roots is None:
        roots = events.select("session_id").distinct().withColumn("root", F.lit(None).cast("string"))
    own = events.join(spread(roots.select("session_id", F.regexp_replace("root", "/+$", "").alias("root"))), "session_id", "left")
    calls = own.where("kind = 'tool_use'").join(spread(results), ["session_id", "tool_use_id"]).where("NOT coalesce(result_error, false)")
    calls = calls.withColumn("tokens", F.coalesce(T.token_estimate("result_text"), F.lit(0))).withColumn("seq", F.col("seq").cast("long") * (1 << 20))
    at = ["session_id", *SIDE, "idx", "seq"]
    tool = F.col("tool_name")

    def resolved(rows: DataFrame) -> DataFrame:
        path = T.absolute_path("path", "cwd")
        known = F.col("root").isNotNull()
        return rows.withColumn("path", F.when(known, F.when(T.within(path, "root") & (path != F.col("root")), T.relative_path(path, "root"))).otherwise(path)).where("path IS NOT NULL")

    no = F.lit(None).cast("boolean")
    read = resolved(calls.where(tool == "Read").withColumn("path", field("file_path")).where("path IS NOT NULL"))
    part = field("offset").isNotNull() | field("limit").isNotNull()
    read = read.select(*at, F.lit("read").alias("op"), "path", "tokens", part.alias("partial"), F.lit(True).alias("exact"), F.lit("Read").alias("tool"))
    edited = resolved(calls.where(tool.isin(EDITORS)).withColumn("path", F.coalesce(field("file_path"), field("notebook_path"))).where("path IS NOT NULL"))
    edited = edited.select(*at, F.lit("mutate").alias("op"), "path", F.lit(None).cast("long").alias("tokens"), no.alias("partial"), F.lit(True).alias("exact"), tool.alias("tool"))

    bash = calls.where(tool == "Bash").withColumn("command", field("command")).where("command IS NOT NULL").select(*at, "command", "cwd", "root", "tokens")
    segs = shell.segments(bash, segs)
    shown = resolved(bash.join(shell.whole_reads(segs), "command"))
    per = shown.groupBy("session_id", "idx", "seq").agg(F.count("*").alias("n"))
    shown = shown.join(spread(per), ["session_id", "idx", "seq"])
    shown = shown.select(*[c for c in at if c != "seq"], (F.col("seq") + F.col("seg_no")).alias("seq"), F.lit("read").alias("op"), "path", T.even_share("tokens", "n").alias("tokens"), F.lit(False).alias("partial"), F.lit(False).alias("exact"), F.lit("Bash").alias("tool"))
    changes = bash.join(shell.mutations(segs), "command")
    changes = resolved(changes.where("path IS NOT NULL")).withColumn("late", F.lit(1 << 18)).unionByName(changes.where("path IS NULL").withColumn("late", F.lit(1 << 19)))
    changes = changes.select(*[c for c in at if c != "seq"], (F.col("seq") + F.col("late") + F.col("seg_no")).alias("seq"), F.lit("mutate").alias("op"), "path", F.lit(None).cast("long").alias("tokens"), no.alias("partial"), F.lit(False).alias("exact"), F.col("label").alias("tool"))
    left = own.where("kind = 'compaction'").select(*[c for c in at if c != "seq"], (F.col("seq").cast("long") * (1 << 20)).alias("seq"), F.lit("compact").alias("op"))
    every = read.unionByName(edited).unionByName(shown).unionByName(changes)
    return every.unionByName(left, allowMissingColumns=True).select(*OPS)
