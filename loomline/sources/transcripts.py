"""Session transcripts: JSON lines to typed events.

A transcript is a text file per session, with further files of subagents beside it; lines may be blank, broken or of
unknown kinds, and are counted rather than refused. Time stamps without an offset are UTC, so sessions should run with
``spark.sql.session.timeZone`` set to UTC.

Lines are (session_id, stream, file, line_no, raw): stream is null for the main chain and the agent's name for a subagent; file tells subagents of one name apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.operators.joins import dealt, tasks_for

#: Line types that carry no event of their own and are no sign of a damaged transcript.
AUXILIARY = [
    "attachment", "last-prompt", "mode", "permission-mode", "file-history-snapshot",
    "ai-title", "agent-name", "progress", "queue-operation",
    "atis-latch", "bridge-session", "cost-state", "file-history-delta",
]
USAGE = "struct<input:bigint,output:bigint,cache_creation:bigint,cache_read:bigint>"
FIELDS = {
    "kind": "string", "text": "string", "tool_name": "string", "tool_input": "string", "tool_use_id": "string",
    "is_error": "boolean", "usage": USAGE, "model": "string", "hook_name": "string", "hook_event": "string",
}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, size, modified, value) of whole text files below ``path``."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified"), "value")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, size, modified) of files below ``path``, without reading them; Spark's readers pass over files of no bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def _session(path: str) -> F.Column:
    """A subagent's file lies in <session>/subagents/; a session's own file bears its name."""
    below = F.regexp_extract(path, r"([^/]+)/subagents/[^/]+$", 1)
    return F.when(below != "", below).otherwise(F.regexp_extract(path, r"([^/]+)\.jsonl$", 1))


def session_units(files: DataFrame) -> DataFrame:
    """(session_id, modified, size, files) of listed files: latest change and total size of a session's files."""
    own = files.where(F.endswith("name", F.lit(".jsonl")))
    return own.groupBy(_session("path").alias("session_id")).agg(F.max("modified").alias("modified"), F.sum("size").alias("size"), F.count("*").alias("files"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, raw) of the lines of all transcripts below ``path``, numbered from 0; a file may be read in many splits.

    A split's rows stand together and in order in their task, so a line's number is its place in the split and the lines of the splits before it; the scan is run
    once for the counts of splits and once for the lines.
    """
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("path", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    splits = splits.select("path", "start", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    return rows.join(splits, ["path", "start"]).select("path", (F.col("ahead") + F.col("at") - F.col("first")).cast("int").alias("line_no"), "raw")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """The small files beside subagents' transcripts, whole, as ``read_files`` gives them."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.meta.json").load(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), "value")


def transcript_lines(files: DataFrame) -> DataFrame:
    """Lines of all transcripts among whole files; blank lines are left out but counted in line_no, which starts at 0."""
    own = files.where(F.endswith("name", F.lit(".jsonl")))
    return labelled_lines(own.select("path", F.posexplode(F.split("value", "\r\n|\r|\n")).alias("line_no", "raw")), files)


def labelled_lines(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Lines (path, line_no, raw) with their session, the name of the subagent that wrote them, and its file; blank lines are left out."""
    labels = files.where(F.endswith("name", F.lit(".meta.json"))).select(F.regexp_replace("path", r"\.meta\.json$", "").alias("stem"), F.get_json_object("value", "$.agentType").alias("label"))
    own = lines.where(T.strip("raw") != "").withColumn("stem", F.regexp_replace("path", r"\.jsonl$", "")).join(labels, "stem", "left")
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]+)\.jsonl$", 1), "^agent-", "")
    below = F.col("path").contains("/subagents/")
    return own.select(_session("path").alias("session_id"), F.when(below, F.coalesce("label", name)).alias("stream"), F.when(below, F.col("stem")).alias("file"), "line_no", "raw")


def parsed_lines(lines: DataFrame) -> DataFrame:
    """Lines with ``v`` (variant, null for a bad line), ``ts``, ``type`` and merged ``idx``.

    A session of one file keeps its line numbers. One with subagents is put in order of time, a line without time
    taking that of the line before it in its file, the main chain first on ties, then file by file, and numbered anew; bad lines get no number.
    """
    v = F.try_parse_json("raw")
    lines = lines.withColumn("v", F.when(F.schema_of_variant(v).startswith("OBJECT"), v))
    lines = lines.withColumn("ts", F.expr("try_cast(try_variant_get(v, '$.timestamp', 'string') AS timestamp)"))
    lines = lines.withColumn("type", F.coalesce(F.expr("try_variant_get(v, '$.type', 'string')"), F.lit("")))
    file = "file" if "file" in lines.columns else "stream"
    per_file = Window.partitionBy("session_id", file).orderBy("line_no")
    lines = lines.withColumn("at", F.last("ts", ignorenulls=True).over(per_file.rowsBetween(Window.unboundedPreceding, 0)))
    session = Window.partitionBy("session_id")
    merged = F.max(F.col("stream").isNotNull()).over(session)
    good = Window.partitionBy("session_id", F.col("v").isNull()).orderBy(F.col("at").asc_nulls_first(), F.col(file).asc_nulls_first(), "line_no")
    return lines.withColumn("idx", F.when(F.col("v").isNull(), None).when(merged, F.row_number().over(good) - 1).otherwise(F.col("line_no")).cast("long")).drop("at")


def _event(kind: str, **given: str) -> str:
    """A struct of all event fields in SQL, null where not given."""
    given = {"kind": f"'{kind}'"} | given
    return "named_struct(" + ", ".join(f"'{k}', cast({given.get(k, 'null')} AS {t})" for k, t in FIELDS.items()) + ")"


def _text(content: str) -> str:
    """SQL for the text of content that is a string or a list of blocks."""
    blocks = f"try_variant_get({content}, '$', 'array<variant>')"
    said = f"transform(filter({blocks}, b -> try_variant_get(b, '$.type', 'string') = 'text'), b -> coalesce(try_variant_get(b, '$.text', 'string'), ''))"
    return f"CASE WHEN schema_of_variant({content}) = 'STRING' THEN try_variant_get({content}, '$', 'string') ELSE coalesce(array_join({said}, '\\n'), '') END"


def events(lines: DataFrame) -> DataFrame:
    """Typed events of parsed lines: session_id, idx, seq, kind, ts, text, tool_name, tool_input (JSON), tool_use_id, is_error, usage, model, hook_name, hook_event, cwd, raw_type, attribution_skill, is_sidechain, agent."""
    content = "variant_get(v, '$.message.content', 'variant')"
    blocks = "try_variant_get(v, '$.message.content', 'array<variant>')"
    get = lambda p, t="string", o="v": f"try_variant_get({o}, '$.{p}', '{t}')"
    result = _event("tool_result", tool_use_id=get("tool_use_id", o="b"), is_error=f"coalesce({get('is_error', 'boolean', 'b')}, false)", text=_text("variant_get(b, '$.content', 'variant')"))
    said = _event("user_msg", text=f"coalesce({get('text', o='b')}, '')")
    own = f"transform(filter({blocks}, b -> {get('type', o='b')} IN ('tool_result', 'text')), b -> CASE WHEN {get('type', o='b')} = 'tool_result' THEN {result} ELSE {said} END)"
    user = f"CASE WHEN size({own}) > 0 THEN {own} ELSE array({_event('user_msg', text=_text(content))}) END"
    count = lambda p: f"coalesce({get('message.usage.' + p, 'bigint')}, 0)"
    usage = f"CASE WHEN startswith(schema_of_variant(variant_get(v, '$.message.usage', 'variant')), 'OBJECT') THEN named_struct('input', {count('input_tokens')}, 'output', {count('output_tokens')}, 'cache_creation', {count('cache_creation_input_tokens')}, 'cache_read', {count('cache_read_input_tokens')}) END"
    answer = _event("assistant_msg", text=_text(content), usage=usage, model=get("message.model"))
    call_input = "CASE WHEN startswith(schema_of_variant(variant_get(b, '$.input', 'variant')), 'OBJECT') THEN to_json(variant_get(b, '$.input', 'variant')) END"
    calls = f"transform(filter({blocks}, b -> {get('type', o='b')} = 'tool_use'), b -> {_event('tool_use', tool_name=get('name', o='b'), tool_input=call_input, tool_use_id=get('id', o='b'))})"
    assistant = f"concat(array({answer}), coalesce({calls}, array()))"
    command = get("command", o="h")
    stop = _event("hook", hook_event="'Stop'", text=command, tool_input=f"CASE WHEN {command} <> '' THEN to_json(named_struct('command', {command})) END")
    hooks = f"transform(CASE WHEN size({get('hookInfos', 'array<variant>')}) > 0 THEN {get('hookInfos', 'array<variant>')} ELSE array(parse_json('{{}}')) END, h -> {stop})"
    name, kind = get("attachment.hookName"), f"coalesce({get('attachment.type')}, '')"
    hook = _event("hook", hook_name=name, hook_event=f"coalesce({get('attachment.hookEvent')}, substring_index({name}, ':', 1))", tool_input=f"to_json(named_struct('attachment_type', {kind}))")
    known = ", ".join(f"'{t}'" for t in AUXILIARY)
    found = f"""CASE
      WHEN v IS NULL THEN array()
      WHEN type = 'user' AND coalesce({get('isCompactSummary', 'boolean')}, false) THEN array({_event('compaction', text=_text(content))})
      WHEN type = 'user' THEN {user}
      WHEN type = 'assistant' THEN {assistant}
      WHEN type = 'system' AND {get('subtype')} = 'compact_boundary' THEN array({_event('compaction')})
      WHEN type = 'system' AND {get('subtype')} = 'stop_hook_summary' THEN {hooks}
      WHEN type = 'system' THEN array({_event('system', text=f"coalesce({get('content')}, {get('text')})")})
      WHEN type = 'summary' THEN array({_event('summary', text=get('summary'))})
      WHEN type = 'attachment' AND startswith({kind}, 'hook_') THEN array({hook})
      WHEN type = 'attachment' THEN array({_event('system', text=kind)})
      WHEN type IN ({known}) THEN array({_event('system')})
      ELSE array({_event('unknown')}) END"""
    side = f"(stream IS NOT NULL OR coalesce({get('isSidechain', 'boolean')}, false))"
    out = lines.select("session_id", "idx", "ts", F.expr(get("cwd")).alias("cwd"), F.col("type").alias("raw_type"), F.expr(get("attributionSkill")).alias("attribution_skill"), F.expr(side).alias("is_sidechain"), F.col("stream").alias("agent"), F.posexplode(F.expr(found)).alias("seq", "e"))
    return out.select("session_id", "idx", "seq", "ts", "cwd", "raw_type", "attribution_skill", "is_sidechain", "agent", "e.*")


def session_health(lines: DataFrame, evs: DataFrame, regression_seconds: int = 300) -> DataFrame:
    """Per session: version, cwd, bad lines, counts of unknown types, parse_status, and whether time runs backwards by more than the limit."""
    own = F.col("stream").isNull()
    first = lambda p: F.min_by(F.expr(f"try_variant_get(v, '$.{p}', 'string')"), F.when(own & F.expr(f"schema_of_variant(variant_get(v, '$.{p}', 'variant')) = 'STRING'"), F.col("line_no")))
    base = lines.groupBy("session_id").agg(T.scrub(first("version")).alias("version"), first("cwd").alias("cwd"), F.count_if(F.col("v").isNull()).alias("bad_lines"))
    unknown = evs.where("kind = 'unknown'").groupBy("session_id", "raw_type").agg(F.count("*").alias("n"))
    unknown = unknown.groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("raw_type", "n")))).alias("unknown_types"), F.sum("n").alias("unknown_lines"))
    order = Window.partitionBy("session_id").orderBy("idx", "seq").rowsBetween(Window.unboundedPreceding, -1)
    back = evs.where("ts IS NOT NULL").withColumn("before", F.max("ts").over(order))
    back = back.groupBy("session_id").agg(F.bool_or(F.unix_micros("before") - F.unix_micros("ts") > regression_seconds * 1_000_000).alias("out_of_order"))
    out = base.join(unknown, "session_id", "left").join(back, "session_id", "left")
    degraded = (F.col("bad_lines") > 0) | F.col("unknown_types").isNotNull()
    return out.select("session_id", "version", "cwd", "bad_lines", "unknown_types", F.coalesce("unknown_lines", F.lit(0)).alias("unknown_lines"), F.coalesce("out_of_order", F.lit(False)).alias("out_of_order"), F.when(degraded, "degraded").otherwise("ok").alias("parse_status"))


def first_results(evs: DataFrame) -> DataFrame:
    """(session_id, tool_use_id, result_idx, is_error, text): the first result of each call; later ones repeat it."""
    order = Window.partitionBy("session_id", "tool_use_id").orderBy("idx", "seq")
    results = dealt(evs.where("kind = 'tool_result' AND tool_use_id <> ''"), tasks_for(evs), "session_id", "tool_use_id")
    results = results.withColumn("no", F.row_number().over(order)).where("no = 1")
    return results.select("session_id", "tool_use_id", F.col("idx").alias("result_idx"), F.col("is_error").alias("result_error"), F.col("text").alias("result_text"))


def owned_sessions(sessions: DataFrame, repos: DataFrame) -> DataFrame:
    """Sessions (session_id, cwd) with the repository (repo_id, root) whose root holds cwd; the longest root wins.

    Each cwd meets its own ancestors by equality, so this stays a hash join for any number of repositories.
    """
    steps = F.concat(F.transform(T.ancestors(F.substr("cwd", F.lit(2))), lambda p: F.concat(F.lit("/"), p)), F.array("cwd"))
    held = sessions.withColumn("root", F.explode(steps)).join(repos, "root")
    best = Window.partitionBy("session_id").orderBy(F.desc(F.length("root")), "repo_id")
    return held.withColumn("no", F.row_number().over(best)).where("no = 1").drop("no")
