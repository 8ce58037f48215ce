"""Which registered components a session loaded or invoked.

Components are (repo_id, id, type, name, source, path, states, hook_event, hook_commands, miss_when, missing, ...). Marks are
(session_id, component_id, state, idx, seq, confidence, summary, tokens, rank, sub); a state is registered, loaded or invoked, tokens are what the mark
brought into context, and rank and sub tell the order of what one event gives. What sessions did carries
the repo_id of its session, and meets the components of that repository only. Joins are by
equality, so that the dimension may be broadcast when it is small and shuffled when it is not. ``attribute`` puts all of them together but the registered
state, which every component of the repository has in every session: ``registered`` gives it where it is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import text as T

from . import shell
from .guidance import written
from .joins import dealt, met, spread, tasks_for

#: Candidates of names that are sent to all tasks; more are shuffled.
FEW = 100_000
#: Pairs of a call and a candidate of its name that one task makes, about.
PAIRS = 50_000_000
#: Calls of a name that meet all of its candidates together, about, where candidates are more. Written rows then repeat these calls in one order for each candidate,
#: which takes little room; so many candidates repeated for each call outgrow a page of the file and its dictionary.
CALLS = 1000
#: Copies of candidates, one for each share of calls, that one task makes.
COPIES = 2_000_000
#: Tools that change a file.
EDITORS = ["Edit", "Write", "MultiEdit", "NotebookEdit"]
MARK = ["session_id", "component_id", "state", "idx", "seq", "confidence", "summary", "tokens", "rank", "sub"]
#: What one event gives, in order: guidance from the start, a line's skill, what was said, the call itself, what it invoked or read, where it worked.
START, LINE, SAID, CALL, DONE, PLACE = range(6)


def mark(rows: DataFrame, state: str, confidence: str | Column, summary: Column | str = "", rank: int = START, tokens: Column | int = 0, sub: Column | int = 0) -> DataFrame:
    c = lambda v: v if isinstance(v, Column) else F.lit(v)
    return rows.select("session_id", "component_id", F.lit(state).alias("state"), "idx", "seq", c(confidence).alias("confidence"), F.left(c(summary), F.lit(200)).alias("summary"), c(tokens).cast("long").alias("tokens"), F.lit(rank).alias("rank"), c(sub).cast("int").alias("sub"))


def weight(components: DataFrame, body: bool = False) -> Column:
    """Tokens of a component: of a skill's body where that is asked for and known, else of all of it."""
    known = [F.nullif(F.col(c), F.lit(0)) if c == "tokens_body_est" else F.col(c) for c in (["tokens_body_est"] if body else []) + ["tokens_est"] if c in components.columns]
    return F.coalesce(*known, F.lit(0)).cast("long")


def spent(calls: DataFrame) -> Column:
    """Tokens of a call's result, where rows have one."""
    return F.coalesce(T.token_estimate("result_text"), F.lit(0)) if "result_text" in calls.columns else F.lit(0)


def registered(first_events: DataFrame, components: DataFrame) -> DataFrame:
    """Every session with events has every component of its repository that is not missing: one row each, at the session's first event."""
    own = components.where("NOT missing").select("repo_id", F.col("id").alias("component_id"))
    return mark(first_events.join(own, "repo_id"), "registered", "exact", "registered in manifest")


def resolved(calls: DataFrame, components: DataFrame, kind: str) -> DataFrame:
    """calls (..., repo_id, name) with the components of that type they name: exact name first, else the part after the last colon.

    For a name with a colon, plugins of the first part come before others. More than one candidate makes it heuristic.
    """
    own = components.where(F.col("type") == kind).select("repo_id", F.col("id").alias("component_id"), F.col("name").alias("c_name"), "source", weight(components).alias("whole"), weight(components, body=True).alias("body"))
    short = F.when(F.col("name").contains(":"), F.regexp_replace("name", "^[^:]*:", ""))
    names = calls.groupBy("repo_id", "name").agg(F.count("*").alias("calls")).select("repo_id", "name", "calls", F.explode(F.array_compact(F.array(F.struct(F.lit(0).alias("rank"), F.col("name").alias("c_name")), F.when(short.isNotNull(), F.struct(F.lit(1).alias("rank"), short.alias("c_name")))))).alias("n")).select("repo_id", "name", "calls", "n.*")
    found = names.join(spread(own), ["repo_id", "c_name"])
    plugin = F.concat(F.lit("plugin:"), F.substring_index("name", ":", 1))
    found = found.withColumn("rank", F.when((F.col("rank") == 1) & ~F.col("source").eqNullSafe(plugin), 2).otherwise(F.col("rank")))
    best = Window.partitionBy("repo_id", "name")
    found = found.withColumn("best", F.min("rank").over(best)).where("rank = best").withColumn("candidates", F.count("*").over(best))
    found = written(found.select("repo_id", "name", "component_id", "whole", "body", F.when(F.col("candidates") > 1, "heuristic").otherwise("exact").alias("sure"), "calls", "candidates"), "names")
    n, pairs, most = found.agg(F.count("*"), F.coalesce(F.sum("calls"), F.lit(0)), F.coalesce(F.max("candidates"), F.lit(0))).first()
    if n <= FEW and pairs <= PAIRS:
        return calls.join(F.broadcast(found.drop("calls", "candidates")), ["repo_id", "name"])
    # Names are few and calls many: the calls of a name that makes many pairs are cut into shares, each with all of its candidates.
    shares = F.ceil(F.greatest(F.col("calls") / (CALLS if most > CALLS else PAIRS), F.col("calls") * F.col("candidates") / PAIRS))
    found = found.withColumn("shares", shares).drop("calls", "candidates")
    spark = calls.sparkSession
    least = spark.sparkContext.defaultParallelism
    heads = found.select("repo_id", "name", "shares").distinct()
    rows = calls.join(F.broadcast(heads) if heads.count() <= FEW else spread(heads), ["repo_id", "name"])
    rows = rows.withColumn("share", F.pmod(F.xxhash64("session_id", "idx", "seq"), F.col("shares"))).drop("shares")
    copies = found.agg(F.sum("shares")).first()[0]
    each = found.repartitionByRange(max(least, -(-copies // COPIES)), "repo_id", "name", "component_id")  # a share's copies leave a task together
    each = each.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).drop("shares")
    # Fewer tasks than Spark's own number would make it shuffle again.
    tasks = max(least, -(-pairs // PAIRS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    outer, inner = (each, rows) if most > CALLS else (rows, each)
    return met(outer, inner, ["repo_id", "name", "share"], tasks).drop("share")


def invoked_by_name(calls: DataFrame, components: DataFrame, kind: str, summary: Column | None = None) -> DataFrame:
    """A command brings its own text into context, other calls their result."""
    said = kind == "command"
    return mark(resolved(calls, components, kind), "invoked", F.col("sure"), F.col("name") if summary is None else summary, SAID if said else DONE, F.col("whole") if said else spent(calls))


def invoked_servers(calls: DataFrame, components: DataFrame) -> DataFrame:
    """Calls of a server's tool: the tool's name holds the server's."""
    own = calls.withColumn("server", T.server_tool("tool_name").server).where("server IS NOT NULL")
    named = components.where("type = 'server'").select("repo_id", F.col("name").alias("server"), F.col("id").alias("component_id"), F.count("*").over(Window.partitionBy("repo_id", "name")).alias("n"))
    return mark(own.join(named, ["repo_id", "server"]), "invoked", F.when(F.col("n") > 1, "heuristic").otherwise("exact"), F.col("tool_name"), DONE, spent(calls))


def invoked_hooks(events: DataFrame, components: DataFrame) -> DataFrame:
    """Hook events by their event's name, whatever its case; with several candidates and a known command, those whose command holds it or is held by it. Always heuristic."""
    own = components.where("type = 'hook'").select("repo_id", F.col("id").alias("component_id"), F.lower("hook_event").alias("event"), "hook_commands")
    fired = events.where("kind = 'hook'").withColumn("event", F.lower("hook_event"))
    found = dealt(fired.join(own, ["repo_id", "event"]), tasks_for(events), "session_id", "idx", "seq")
    fits = F.coalesce(F.exists("hook_commands", lambda c: F.contains(c, F.col("text")) | F.contains(F.col("text"), c)), F.lit(False))
    each = Window.partitionBy("session_id", "idx", "seq")
    found = found.withColumn("fits", fits).withColumn("n", F.count("*").over(each)).withColumn("any", F.max("fits").over(each))
    return mark(found.where("n = 1 OR NOT any OR fits"), "invoked", "heuristic", F.coalesce("text", "hook_event"), SAID)


def _told(reads: DataFrame) -> tuple[Column, Column]:
    return tuple(F.col(c) if c in reads.columns else F.lit(0) for c in ("tokens", "sub"))


def loaded_by_path(reads: DataFrame, components: DataFrame, confidence: str = "exact") -> DataFrame:
    """Reads (..., path) of a component's own file; their tokens and places, sub, count where they have any."""
    own = components.where("path IS NOT NULL").select("repo_id", F.col("id").alias("component_id"), "path")
    return mark(reads.join(own, ["repo_id", "path"]), "loaded", confidence, F.col("path"), DONE, *_told(reads))


def loaded_by_directory(touched: DataFrame, components: DataFrame) -> DataFrame:
    """Paths touched, or directories worked in, at or below a directory whose guidance file is a component: each meets itself and its own ancestors, by equality."""
    own = components.where("path LIKE '%/%'").select("repo_id", F.col("id").alias("component_id"), F.regexp_replace("path", "/[^/]+$", "").alias("dir"))
    return mark(touched.withColumn("dir", F.explode(F.concat(T.ancestors("path"), F.array("path")))).join(own, ["repo_id", "dir"]), "loaded", "heuristic", F.col("path"), PLACE)


def skill_file_reads(reads: DataFrame, components: DataFrame) -> DataFrame:
    """Reads of <name>/SKILL.md by the skill's name alone, wherever the file lies."""
    named = reads.where(F.endswith("path", F.lit("SKILL.md"))).withColumn("name", F.try_element_at(F.split("path", "/"), F.lit(-2)))
    own = components.where("type = 'skill'").select("repo_id", F.col("id").alias("component_id"), "name")
    return mark(named.join(own, ["repo_id", "name"]), "loaded", "heuristic", F.col("path"), DONE, _told(reads)[0], 1)


def first_per_session(marks: DataFrame, extra: DataFrame) -> DataFrame:
    """marks, and those of ``extra`` whose component has no earlier mark in the session: one at most. On one event, extra comes first."""
    both = marks.withColumn("own", F.lit(1)).unionByName(extra.withColumn("own", F.lit(0)))
    order = Window.partitionBy("session_id", "component_id").orderBy("idx", "seq", "own")
    return both.withColumn("no", F.row_number().over(order)).where("own = 1 OR no = 1").drop("own", "no")


def applicable(marks: DataFrame, components: DataFrame) -> DataFrame:
    """Marks in a state that their component can be in; marks with a repo_id meet the components of that repository."""
    key = ["repo_id", "component_id"] if "repo_id" in marks.columns else ["component_id"]
    own = components.withColumnRenamed("id", "component_id").select(*key, "states")
    return marks.join(own, key).where(F.array_contains("states", F.col("state"))).select(marks.columns)


def usages(marks: DataFrame, shown: int = 50) -> DataFrame:
    """Per (session, component, state): count, confidence, and the first ``shown`` marks as evidence.

    Marks are dealt once, by key, and those beyond ``shown`` are null before rows are gathered.
    """
    key = ["session_id", "component_id", "state"]
    order = Window.partitionBy(*key).orderBy("idx", "seq")
    rows = dealt(marks.dropna(subset=key), tasks_for(marks), *key).withColumn("no", F.row_number().over(order))
    few = F.when(F.col("no") <= shown, F.struct("idx", "seq", "summary"))
    return rows.groupBy(*key).agg(F.count("*").alias("count"), F.max("confidence").alias("confidence"), F.array_sort(F.collect_list(few)).alias("evidence"))


def session_stats(events: DataFrame, digest: int = 80) -> DataFrame:
    """Per session: start, end, turns, tokens, compactions, the first real prompt and the first summary."""
    main = ~F.col("is_sidechain")
    said = (F.col("kind") == "user_msg") & main & (T.strip("text") != "")
    turn = said & ~F.startswith("text", F.lit("Caveat:"))
    at = F.struct("idx", "seq")
    prompt = F.min_by("text", F.when(said & ~T.boilerplate("text"), at))
    tokens = lambda c: F.coalesce(F.sum(f"usage.{c}"), F.lit(0)).alias(f"{c}_tokens")
    return events.groupBy("session_id").agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count_if(turn).alias("turns"), tokens("input"), tokens("output"), tokens("cache_creation"), tokens("cache_read"),
        F.count_if(F.col("kind") == "compaction").alias("compactions"), F.left(F.regexp_replace(T.scrub(prompt), r"\s+", " "), F.lit(digest)).alias("prompt_digest"),
        F.min_by("text", F.when((F.col("kind") == "summary") & (F.col("text") != ""), at)).alias("summary"),
    )


def commit_counts(calls: DataFrame, committing: DataFrame) -> DataFrame:
    """(session_id, commits, evidence): calls (session_id, idx, command, result_text) whose command commits and whose result shows it."""
    own = calls.join(committing, "command").where(T.commit_confirmed("result_text"))
    return own.groupBy("session_id").agg(F.count("*").alias("commits"), F.array_sort(F.collect_list("idx")).alias("evidence"))


def missed_hooks(sessions: DataFrame, uses: DataFrame, components: DataFrame) -> DataFrame:
    """(repo_id, component_id, missed): sessions (session_id, repo_id, commits) with commits in which a hook that should see them was never invoked.

    Sessions with commits less those in which the hook was seen: no pair of session and hook is ever made.
    """
    due = components.where("type = 'hook' AND miss_when = 'git_commit'").select("repo_id", F.col("id").alias("component_id")).distinct()
    asked = sessions.where("commits > 0").select("session_id", "repo_id")
    total = asked.groupBy("repo_id").agg(F.countDistinct("session_id").alias("sessions"))
    seen = uses.where("state = 'invoked' AND count > 0").select("session_id", "component_id")
    seen = met(seen, asked, ["session_id"], tasks_for(asked)).join(due, ["repo_id", "component_id"], "left_semi")
    seen = seen.groupBy("repo_id", "component_id").agg(F.countDistinct("session_id").alias("seen"))
    out = due.join(total, "repo_id", "left").join(seen, ["repo_id", "component_id"], "left")
    return out.select("repo_id", "component_id", (F.coalesce("sessions", F.lit(0)) - F.coalesce("seen", F.lit(0))).alias("missed"))


def session_misses(sessions: DataFrame, uses: DataFrame, components: DataFrame) -> DataFrame:
    """(session_id, component_id): for sessions with commits, each due hook of the repository that never ran. For reports on few sessions; totals come from missed_hooks."""
    due = components.where("type = 'hook' AND miss_when = 'git_commit'").select("repo_id", F.col("id").alias("component_id"))
    seen = uses.where("state = 'invoked' AND count > 0").select("session_id", "component_id")
    asked = sessions.where("commits > 0").select("session_id", "repo_id").join(due, "repo_id").select("session_id", "component_id")
    # An anti join is pushed below the dealing of its rows; a left join is not.
    found = met(asked, seen.withColumn("seen", F.lit(True)), ["session_id", "component_id"], tasks_for(asked), "left")
    return found.where("seen IS NULL").select("session_id", "component_id")


#: Fixed value: how a message begins that brings a skill's text into context.
EXPANSION = "Base directory for this skill:"


def expanded_skills(events: DataFrame, components: DataFrame) -> DataFrame:
    """Skills loaded by a message that gives their directory: the directory's name is the skill's; among several, those whose own directory ends the given one. A directory of no skill's name may still be one's by path."""
    said = events.where((F.col("kind") == "user_msg") & F.startswith(T.strip("text"), F.lit(EXPANSION)))
    given = F.regexp_extract(T.strip("text"), rf"^{EXPANSION}[ \t]*([^\r\n]*)", 1)
    said = said.withColumn("dir", F.regexp_replace(T.strip(given), "/+$", "")).withColumn("name", F.element_at(F.split("dir", "/"), -1))
    own = components.where("type = 'skill'").select("repo_id", F.col("id").alias("component_id"), "name", F.regexp_replace("path", "/[^/]+$", "").alias("home"), weight(components, body=True).alias("body"))
    each = Window.partitionBy("repo_id", "dir")
    dirs = said.where("dir <> ''").select("repo_id", "dir", "name").distinct()
    named = dirs.join(own, ["repo_id", "name"]).withColumn("fits", F.coalesce(F.endswith("dir", F.col("home")), F.lit(False)))
    named = named.withColumn("any", F.max("fits").over(each)).where("fits OR NOT any").withColumn("n", F.count("*").over(each))
    # A directory that ends with a skill's home has that home among its own endings, so this is a join by equality too.
    steps = F.split("dir", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, k, F.size(steps)), "/"))
    other = dirs.join(named.select("repo_id", "dir"), ["repo_id", "dir"], "left_anti").withColumn("home", F.explode(ends)).join(own.drop("name"), ["repo_id", "home"]).withColumn("n", F.count("*").over(each))
    found = named.select("repo_id", "dir", "component_id", "body", "n").unionByName(other.select("repo_id", "dir", "component_id", "body", "n"))
    return mark(said.join(found, ["repo_id", "dir"]), "loaded", F.when(F.col("n") > 1, "heuristic").otherwise("exact"), F.col("dir"), SAID, F.col("body"))


def always_loaded(first_events: DataFrame, components: DataFrame) -> DataFrame:
    """Guidance of the repository that is in context from the start, at each session's first event."""
    own = components.where("type = 'guide' AND context = 'static' AND NOT missing").select("repo_id", F.col("id").alias("component_id"), weight(components).alias("whole"))
    return mark(first_events.join(own, "repo_id"), "loaded", "exact", "always in context", START, F.col("whole"))


def first_events(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, repo_id, idx, seq): each session's first event; sessions: (session_id, repo_id)."""
    tasks = tasks_for(events)
    first = dealt(events.select("session_id", "idx", "seq"), tasks, "session_id").groupBy("session_id").agg(F.min(F.struct("idx", "seq")).alias("at"))
    return met(first, sessions.select("session_id", "repo_id"), ["session_id"], tasks).select("session_id", "repo_id", "at.idx", "at.seq")


def attribute(events: DataFrame, results: DataFrame, components: DataFrame, sessions: DataFrame, reads: DataFrame) -> DataFrame:
    """All marks of typed events and their first results, registered ones apart.

    sessions: (session_id, repo_id, root). reads: what ``timeline.file_reads`` finds.
    A component's own path is relative to its repository, and so are paths before they meet it; those outside meet nothing.
    """
    at = ["session_id", "repo_id", "root", "idx", "seq"]
    components = components.where("NOT missing")
    first, tasks = first_events(events, sessions), tasks_for(events)
    events = met(events, sessions.select("session_id", "repo_id", "root"), ["session_id"], tasks)
    field = lambda p: F.get_json_object("tool_input", f"$.{p}")
    calls = met(events.where("kind = 'tool_use'"), results, ["session_id", "tool_use_id"], tasks, "left").withColumn("ok", F.coalesce(~F.col("result_error"), F.lit(False)))
    # Each kind of mark reads these, so that they are made once.
    calls = written(calls.select(*at, "tool_name", "tool_input", "cwd", "ok", "result_text"), "calls")
    lines = ["kind", "text", "is_sidechain", "hook_event", "attribution_skill"]
    events = written(events.where("kind IN ('user_msg', 'hook') OR attribution_skill IS NOT NULL").select(*at, *lines), "lines")
    tool = F.col("tool_name")
    inside = lambda c: T.path_under(c, F.col("root"))

    skills = calls.where((tool == "Skill") & F.col("ok")).select(*at, "result_text", field("skill").alias("name")).where("name IS NOT NULL")
    agents = calls.where(tool.isin("Task", "Agent")).select(*at, "result_text", "tool_name", field("subagent_type").alias("name")).where("name IS NOT NULL")
    said = events.where("kind = 'user_msg' AND NOT is_sidechain").select(*at, T.command_name("text").alias("name")).where("name IS NOT NULL")
    marks = invoked_by_name(skills, components, "skill", F.format_string("Skill(%s) completed", "name"))
    marks = marks.unionByName(invoked_by_name(agents, components, "agent", F.format_string("%s(subagent_type=%s)", "tool_name", "name")))
    marks = marks.unionByName(invoked_by_name(said, components, "command", F.concat(F.lit("/"), "name")))
    marks = marks.unionByName(invoked_servers(calls, components)).unionByName(invoked_hooks(events, components))

    own_path = components.where(F.col("type").isin("file", "guide"))
    shown = reads.where("repo_id IS NOT NULL").drop("component_id")
    loaded = loaded_by_path(shown.where("tool = 'Read' AND inside"), own_path).unionByName(loaded_by_path(shown.where("tool = 'Bash'"), own_path, "heuristic"))
    loaded = loaded.unionByName(skill_file_reads(shown.where("tool = 'Read'").withColumn("path", F.col("target")), components))
    bash = calls.where(tool == "Bash").where(field("command").isNotNull())
    target = F.coalesce(field("file_path"), field("notebook_path"))
    touched = calls.where(tool.isin(EDITORS)).select(*at, inside(target).alias("path")).unionByName(bash.select(*at, inside(F.col("cwd")).alias("path"))).where("path IS NOT NULL")
    loaded = loaded.unionByName(loaded_by_directory(touched, components.where("type = 'guide' AND context <> 'static'")))
    loaded = loaded.unionByName(expanded_skills(events, components)).unionByName(always_loaded(first, components))

    expansion = (F.col("kind") == "user_msg") & F.startswith("text", F.lit(EXPANSION))
    tagged = events.where(F.col("attribution_skill").isNotNull() & ~F.coalesce(expansion, F.lit(False))).select(*at, F.col("attribution_skill").alias("name"))
    tagged = mark(resolved(tagged, components, "skill"), "loaded", F.col("sure"), F.concat(F.lit("attributionSkill="), "name"), LINE, F.col("body"))
    able = lambda rows: applicable(met(rows, sessions.select("session_id", "repo_id"), ["session_id"], tasks), components).select(*MARK)
    return able(marks).unionByName(first_per_session(able(loaded), able(tagged)))
