"""What happened in a session, row by row: actions, files read, components loaded and invoked, compactions, copies that went stale.

Entries are (session_id, idx, seq, rank, sub, kind, component_id, state, tool, detail, confidence, tokens, is_sidechain, agent, ts): what one
event gives is ordered by rank and sub. A result's tokens count once: with the files that a shell command turned out to read, else with the command.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import text as T

from . import attribution, shell, windows
from .attribution import CALL, DONE, EDITORS, SAID, START
from .joins import dealt, met, spread, tasks_for

ENTRY = ["session_id", "idx", "seq", "rank", "sub", "kind", "component_id", "state", "tool", "detail", "confidence", "tokens", "is_sidechain", "agent", "ts"]
READ = ["session_id", "repo_id", "idx", "seq", "sub", "path", "target", "inside", "tool", "confidence", "tokens", "range", "component_id", "is_sidechain", "agent"]
#: The tool of guidance that no call brought into context.
INJECTED = "system-injected"


def calls_with_results(events: DataFrame, results: DataFrame, owned: DataFrame) -> DataFrame:
    """Tool calls with their first result, its tokens, whether it is there and whether it failed, and the session's repository."""
    tasks = tasks_for(events)
    calls = met(events.where("kind = 'tool_use'"), results, ["session_id", "tool_use_id"], tasks, "left")
    calls = met(calls, owned.select("session_id", "repo_id", "root"), ["session_id"], tasks, "left")
    failed = F.coalesce("result_error", F.lit(False))
    return calls.withColumns({"failed": F.col("result_idx").isNotNull() & failed, "ok": F.col("result_idx").isNotNull() & ~failed, "tokens": F.coalesce(T.token_estimate("result_text"), F.lit(0))})


def file_reads(events: DataFrame, results: DataFrame, owned: DataFrame, files: DataFrame, components: DataFrame, segs: DataFrame | None = None) -> DataFrame:
    """Files that came into context: by Read, by a shell command that names files of the repository, or, for guidance that is always there, with the first event.

    path is relative to the repository where inside. A command's tokens go in even shares to the files it reads. component_id is a component whose own file
    it is, a skill's by its name.
    """
    calls = calls_with_results(events, results, owned).where("ok")
    field = lambda p: F.get_json_object("tool_input", f"$.{p}")
    read = calls.where("tool_name = 'Read'").withColumn("target", field("file_path")).where("target IS NOT NULL")
    below = T.path_under(F.col("target"), F.col("root"))
    read = read.withColumns({"path": F.coalesce(below, "target"), "inside": F.coalesce(below.isNotNull(), F.lit(False)), "tool": F.lit("Read"), "confidence": F.lit("exact"), "sub": F.lit(0), "range": T.read_range(field("offset").cast("long"), field("limit").cast("long"))})
    bash = calls.where("tool_name = 'Bash'").withColumn("command", field("command")).where("command IS NOT NULL")
    named = bash.join(shell.read_paths(shell.segments(bash, segs)).select("command", "seg_no", "pos", F.col("path").alias("target")), "command")
    named = named.withColumn("path", T.path_under(T.absolute_path("target", "cwd"), F.col("root"))).join(files.select("repo_id", "path"), ["repo_id", "path"], "left_semi")
    event, tasks = Window.partitionBy("session_id", "idx", "seq"), tasks_for(events)
    named = dealt(named, tasks, "session_id", "idx", "seq").withColumn("sub", F.row_number().over(event.orderBy("seg_no", "pos")) - 1).withColumn("tokens", T.even_share("tokens", F.count("*").over(event)))
    named = named.withColumns({"inside": F.lit(True), "tool": F.lit("Bash"), "confidence": F.lit("heuristic"), "range": F.lit(None).cast(read.schema["range"].dataType)})

    present = components.where("NOT missing")
    own = present.where(F.col("type").isin("file", "guide") & F.col("path").isNotNull()).groupBy("repo_id", "path").agg(F.min("id").alias("by_path"))
    skills = present.where("type = 'skill'").groupBy("repo_id", "name").agg(F.min("id").alias("by_name"))
    columns = [c for c in READ if c != "component_id"]
    rows = read.select(columns).unionByName(named.select(columns)).join(own, ["repo_id", "path"], "left")
    rows = rows.withColumn("name", F.when((F.col("tool") == "Read") & F.endswith("target", F.lit("SKILL.md")), F.try_element_at(F.split("target", "/"), F.lit(-2)))).join(skills, ["repo_id", "name"], "left")
    rows = rows.withColumn("component_id", F.coalesce(F.when(F.col("inside"), F.col("by_path")), "by_name"))
    always = present.where("type = 'guide' AND context = 'static'").select("repo_id", F.col("id").alias("component_id"), F.coalesce("path", "source", "name").alias("path"), attribution.weight(present).alias("tokens"))
    sides = dealt(events.select("session_id", "idx", "seq", "is_sidechain", "agent"), tasks, "session_id").groupBy("session_id").agg(F.min(F.struct("idx", "seq", "is_sidechain", "agent")).alias("e"))
    always = met(attribution.first_events(events, owned).join(always, "repo_id"), sides.select("session_id", "e.is_sidechain", "e.agent"), ["session_id"], tasks)
    always = always.withColumns({"sub": F.lit(0), "target": F.col("path"), "inside": F.lit(True), "tool": F.lit(INJECTED), "confidence": F.lit("exact")})
    return rows.select(READ).unionByName(always.select([c for c in READ if c != "range"]), allowMissingColumns=True).withColumn("path", T.scrub("path"))


def said_tokens() -> Column:
    """Tokens of all texts among a call's arguments."""
    given = "map_values(try_variant_get(try_parse_json(tool_input), '$', 'map<string,variant>'))"
    texts = f"transform(filter({given}, x -> schema_of_variant(x) = 'STRING'), x -> variant_get(x, '$', 'string'))"
    return F.coalesce(F.aggregate(F.expr(texts), F.lit(0).cast("long"), lambda a, t: a + T.token_estimate(t)), F.lit(0))


def actions(events: DataFrame, results: DataFrame, owned: DataFrame, reads: DataFrame) -> DataFrame:
    """Edits and shell commands. An edit counts its arguments and its result; a command its arguments, and its result unless that went to files read."""
    calls = calls_with_results(events, results, owned).where(F.col("tool_name").isin(*EDITORS, "Bash"))
    field = lambda p: F.get_json_object("tool_input", f"$.{p}")
    shown = reads.where("tool = 'Bash'").select("session_id", "idx", "seq").distinct().withColumn("shown", F.lit(True))
    calls = calls.join(spread(shown), ["session_id", "idx", "seq"], "left")
    target = F.coalesce(field("file_path"), field("notebook_path"), F.lit(""))
    path = F.coalesce(T.path_under(F.nullif(target, F.lit("")), F.col("root")), target)
    bash = F.col("tool_name") == "Bash"
    detail = F.concat(F.when(bash, F.replace(T.strip(F.coalesce(field("command"), F.lit(""))), F.lit("\n"), F.lit(" ⏎ "))).otherwise(path), F.when(F.col("failed"), " (failed)").otherwise(""))
    tokens = said_tokens() + F.when(F.col("shown").isNull(), F.col("tokens")).otherwise(0)
    return calls.select("session_id", "idx", "seq", F.lit(CALL).alias("rank"), F.lit(0).alias("sub"), F.lit("action").alias("kind"), F.col("tool_name").alias("tool"), detail.alias("detail"), F.lit("exact").alias("confidence"), tokens.alias("tokens"))


def entries(events: DataFrame, results: DataFrame, components: DataFrame, owned: DataFrame, marks: DataFrame, reads: DataFrame) -> DataFrame:
    """All entries of sessions, in no order: marks other than registered, actions, files read that are no component's, compactions."""
    kinds = components.groupBy("repo_id", F.col("id").alias("component_id")).agg(F.min("type").alias("kind"))
    of = marks.where("state <> 'registered'").join(spread(owned.select("session_id", "repo_id")), "session_id").join(kinds, ["repo_id", "component_id"])
    twice = F.when(F.col("rank") == DONE, 2 * F.col("sub")).otherwise(F.col("sub"))
    of = of.select("session_id", "idx", "seq", "rank", twice.alias("sub"), "kind", "component_id", "state", F.col("summary").alias("detail"), "confidence", "tokens")
    read = reads.where((F.col("tool") != INJECTED) & F.col("component_id").isNull())
    read = read.select("session_id", "idx", "seq", F.lit(DONE).alias("rank"), (2 * F.col("sub") + 1).alias("sub"), F.lit("file_read").alias("kind"), F.concat_ws(" ", "tool", "path").alias("detail"), "confidence", "tokens", "tool")
    left = events.where("kind = 'compaction'").select("session_id", "idx", "seq", F.lit(SAID).alias("rank"), F.lit(0).alias("sub"), F.lit("compaction").alias("kind"), F.lit("compaction").alias("detail"), F.lit("exact").alias("confidence"), F.lit(0).cast("long").alias("tokens"))
    rows = of.unionByName(actions(events, results, owned, reads), allowMissingColumns=True).unionByName(read, allowMissingColumns=True).unionByName(left, allowMissingColumns=True)
    rows = rows.join(spread(events.select("session_id", "idx", "seq", "is_sidechain", "agent", "ts")), ["session_id", "idx", "seq"])
    return rows.withColumn("detail", T.agent_tagged("detail", "is_sidechain", "agent")).select(ENTRY)


def session_timeline(entries: DataFrame, bounds: DataFrame, stale: DataFrame, samples: DataFrame) -> DataFrame:
    """Entries between the bounds of their sessions, with rows for stale copies and notes where these end, numbered from 1, and what the main context held.

    What is always in context comes before all else at its line. bounds: ``windows.session_bounds``; samples: ``windows.context_samples``.
    """
    bounds = bounds.withColumns({"confidence": F.lit("exact"), "tokens": F.lit(0).cast("long")})
    rows = entries.withColumn("early", F.col("rank") == START).unionByName(bounds, allowMissingColumns=True)
    order = Window.partitionBy("session_id").orderBy("idx", F.coalesce("early", F.lit(False)).desc(), "seq", "rank", "sub", "component_id", "state")
    rows = rows.withColumn("no", F.row_number().over(order)).withColumn("is_sidechain", F.coalesce("is_sidechain", F.lit(False))).drop("early")
    rows = windows.with_stale_rows(rows, stale)
    times = entries.groupBy("session_id", "idx").agg(F.min("ts").alias("at"))
    rows = rows.join(spread(times), ["session_id", "idx"], "left").withColumn("ts", F.coalesce("ts", "at")).drop("at")
    return windows.measured(rows, samples, rows.where("kind = 'compaction'"))


def lane(rows: DataFrame) -> Column:
    """Which lane of a session's map a row falls into: load, act, or none."""
    load = (F.col("kind") == "file_read") | (F.col("state") == "loaded")
    return F.when(load, "load").when((F.col("kind") == "action") | (F.col("state") == "invoked"), "act")


def bins(rows: DataFrame, samples: DataFrame, width: int = 60, scroll: bool = False) -> DataFrame:
    """(session_id, lane, bin, est, last_no, largest): a timeline's loads and actions of the main context in bins of the ranks of all its lines and samples."""
    own = rows.where("NOT is_sidechain").select("session_id", lane(rows).alias("lane"), "idx", "no", F.col("tokens").alias("est"))
    every = own.unionByName(samples.select("session_id", "idx"), allowMissingColumns=True)
    return windows.binned(every.withColumn("est", F.coalesce("est", F.lit(0))), width, "idx", scroll).where("lane IS NOT NULL")
