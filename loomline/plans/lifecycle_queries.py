"""Queries over whole sessions: customers are sessions, each plays the same script with words, results and a repository of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.operators import attribution, facts, reports, shell, stale, timeline, windows
from loomline.operators.guidance import written
from loomline.sources import transcripts

from .registry import query, table


def nth() -> Column:
    """A session's number."""
    return F.col("k")


def root() -> Column:
    return F.format_string("/w/r%d", nth() % 3)


def step(idx: int, kind: str, tool: str | None = None, given: dict[str, Column] | None = None, text: Column | str | None = None, result: Column | str | None = None, failed: Column | None = None, cwd: Column | None = None, skill: str | None = None, event: str | None = None, when: Column | None = None, agent: str | None = None, usage: Column | None = None) -> Column:
    """The events of one step of a script, as an array: what happens at line 2 * idx, and the result of a call at the line after."""
    c = lambda v, t="string": (v if isinstance(v, Column) else F.lit(v)).cast(t)
    name = F.lit(f"t{idx}") if tool else F.lit(None).cast("string")
    given = F.to_json(F.struct(*[c(v).alias(k) for k, v in given.items()])) if given else F.lit(None).cast("string")

    def row(at: int, what: str, **own: Column) -> Column:
        base = {"idx": c(at, "long"), "kind": c(what), "text": c(None), "tool_name": c(None), "tool_input": c(None), "tool_use_id": c(None), "is_error": c(None, "boolean"), "hook_event": c(None), "cwd": c(cwd), "attribution_skill": c(skill), "agent": c(agent), "usage": (usage if usage is not None else F.lit(None)).cast(transcripts.USAGE)}
        return F.struct(*[v.alias(k) for k, v in {**base, **own}.items()])

    rows = [row(2 * idx, kind, text=c(text), tool_name=c(tool), tool_input=given, tool_use_id=name, hook_event=c(event))]
    if result is not None:
        rows.append(row(2 * idx + 1, "tool_result", text=c(result), tool_use_id=name, is_error=failed if failed is not None else F.lit(False)))
    out = F.array(*rows)
    return out if when is None else F.when(when, out).otherwise(F.slice(out, 1, 0))


def played(spark: SparkSession, sf_dir: str, steps: list[Column]) -> DataFrame:
    """Events of all sessions, with what the readers of transcripts would give."""
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"), F.col("c_custkey").alias("k"))
    # Sessions are played by all cores: their table is so small that one task would read it.
    own = own.repartition(spark.sparkContext.defaultParallelism, "session_id")
    rows = own.select("session_id", F.explode(F.concat(*steps)).alias("e")).select("session_id", "e.*")
    return rows.withColumns({"seq": F.lit(0), "is_sidechain": F.col("agent").isNotNull(), "ts": F.timestamp_seconds(F.col("idx"))})


def _owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"), F.col("c_custkey").alias("k")).select("session_id", F.format_string("r%d", nth() % 3).alias("repo_id"), root().alias("root"))


# --- attribution over three repositories that share names and paths ---

ALL, LOADS, RUNS = ["registered", "loaded", "invoked"], ["registered", "loaded"], ["registered", "invoked"]
#: repositories, id, type, name, source, path, context, states, missing
COMPONENTS = [
    ("r0 r1 r2", "command:go", "command", "go", "plugin:review", None, "dynamic", RUNS, False), ("r0 r1", "skill:fmt", "skill", "fmt", None, ".claude/skills/fmt/SKILL.md", "dynamic", ALL, False),
    ("r1", "skill:fmt@plugin", "skill", "fmt", "plugin:p", None, "dynamic", ALL, False), ("r0 r2", "skill:lint", "skill", "lint", None, ".claude/skills/lint/SKILL.md", "dynamic", ALL, False),
    ("r0 r1 r2", "agent:scout", "agent", "scout", None, None, "dynamic", RUNS, False), ("r0", "server:db", "server", "db", None, None, "dynamic", RUNS, False), ("r0 r1 r2", "hook:pre", "hook", "pre", None, None, "dynamic", RUNS, False),
    ("r0 r1 r2", "file:a", "file", "a", None, "src/a.py", "dynamic", LOADS, False), ("r0 r1", "file:x", "file", "x", None, "docs/x.md", "dynamic", LOADS, False), ("r0 r1 r2", "guide:root", "guide", "root", None, "CLAUDE.md", "static", LOADS, False),
    ("r1", "guide:src", "guide", "src", None, "src/CLAUDE.md", "dynamic", LOADS, False), ("r0", "guide:src", "guide", "src", None, "src/CLAUDE.md", "dynamic", LOADS, True),
]


def components(spark: SparkSession) -> DataFrame:
    rows = [(r, *c[1:]) for c in COMPONENTS for r in c[0].split()]
    out = spark.createDataFrame(rows, "repo_id string, id string, type string, name string, source string, path string, context string, states array<string>, missing boolean")
    hook = F.col("type") == "hook"
    # A list of this module, of the same size for any tables.
    return F.broadcast(out.withColumns({"hook_event": F.when(hook, "PreToolUse"), "hook_commands": F.when(hook, F.array(F.lit("lint"))), "miss_when": F.when(hook, "git_commit")}))


def listed(spark: SparkSession, *paths: str) -> DataFrame:
    """These files in each of the three repositories."""
    return F.broadcast(spark.createDataFrame([(f"r{k}", p) for k in range(3) for p in paths], "repo_id string, path string"))


def said(events: DataFrame) -> DataFrame:
    """Segments of the distinct commands as a table, so that joins know whether they are few."""
    command = F.get_json_object("tool_input", "$.command").alias("command")
    return written(shell.segments(events.where("tool_name = 'Bash'").select(command).where("command IS NOT NULL")), "segments")


def _worked(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda p: F.concat(root(), F.lit(p))
    even = nth() % 2 == 0
    return played(spark, sf_dir, [
        step(0, "user_msg", text="/review:go now"), step(1, "assistant_msg", text="on it"), step(2, "tool_use", "Skill", {"skill": "fmt"}, result="done", failed=~even), step(3, "tool_use", "Task", {"subagent_type": "scout"}, result="found"),
        step(4, "tool_use", "mcp__db__query", {"q": "x"}, result="rows"), step(5, "hook", text="sh lint", event="pretooluse", when=nth() % 5 == 0), step(6, "tool_use", "Read", {"file_path": at("/src/a.py")}, result="text"),
        step(7, "tool_use", "Edit", {"file_path": at("/src/sub/b.py")}, result="ok"), step(8, "tool_use", "Bash", {"command": "cat ../docs/x.md | head -n 5; git commit -m a"}, result="[main 1a2b3c4d] done", cwd=at("/src")),
        step(9, "user_msg", text=F.concat(F.lit("Base directory for this skill: "), root(), F.lit("/.claude/skills/fmt\nrest"))), step(10, "assistant_msg", text="a", skill="lint"), step(11, "assistant_msg", text="b", skill="lint"),
        step(12, "tool_use", "Read", {"file_path": "/else/CLAUDE.md"}, result="text"), step(13, "tool_use", "Read", {"file_path": at("/CLAUDE.md")}, result="text", failed=~even),
    ])


MARKS = """WITH c AS (SELECT c_custkey AS session_id, c_custkey % 3 AS r, c_custkey AS k FROM customer), x(repos, component_id, state, idx, confidence, every) AS (VALUES
  ('012', 'command:go', 'invoked', 0, 'exact', 1), ('0', 'skill:fmt', 'invoked', 2, 'exact', 2), ('1', 'skill:fmt', 'invoked', 2, 'heuristic', 2), ('1', 'skill:fmt@plugin', 'invoked', 2, 'heuristic', 2), ('012', 'agent:scout', 'invoked', 3, 'exact', 1),
  ('0', 'server:db', 'invoked', 4, 'exact', 1), ('012', 'hook:pre', 'invoked', 5, 'heuristic', 5), ('012', 'file:a', 'loaded', 6, 'exact', 1), ('1', 'guide:src', 'loaded', 7, 'heuristic', 1), ('1', 'guide:src', 'loaded', 8, 'heuristic', 1),
  ('01', 'file:x', 'loaded', 8, 'heuristic', 1), ('01', 'skill:fmt', 'loaded', 9, 'exact', 1), ('02', 'skill:lint', 'loaded', 10, 'exact', 1), ('012', 'guide:root', 'loaded', 0, 'exact', 1), ('012', 'guide:root', 'loaded', 13, 'exact', 2),
  ('012', 'command:go', 'registered', 0, 'exact', 1), ('01', 'skill:fmt', 'registered', 0, 'exact', 1), ('1', 'skill:fmt@plugin', 'registered', 0, 'exact', 1), ('02', 'skill:lint', 'registered', 0, 'exact', 1), ('012', 'agent:scout', 'registered', 0, 'exact', 1),
  ('0', 'server:db', 'registered', 0, 'exact', 1), ('012', 'hook:pre', 'registered', 0, 'exact', 1), ('012', 'file:a', 'registered', 0, 'exact', 1), ('01', 'file:x', 'registered', 0, 'exact', 1), ('012', 'guide:root', 'registered', 0, 'exact', 1), ('1', 'guide:src', 'registered', 0, 'exact', 1)
), m AS (SELECT session_id, r, component_id, state, CAST(2 * idx AS BIGINT) AS idx, confidence FROM c JOIN x ON contains(repos, CAST(r AS VARCHAR)) AND k % every = 0)"""


def _attributed(events: DataFrame, found: DataFrame, owned: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, reads, marks) of played events, as a sync would write them."""
    results = written(transcripts.first_results(events), "results")
    reads = written(timeline.file_reads(events, results, owned, files, found, said(events)), "reads")
    return results, reads, written(attribution.attribute(events, results, found, owned, reads), "marks")


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, owned = written(_worked(spark, sf_dir), "events"), _owned(spark, sf_dir)
    marks = _attributed(events, components(spark), owned, listed(spark, "docs/x.md"))[2]
    return marks.unionByName(written(attribution.registered(attribution.first_events(events, owned), components(spark)), "registered"))


@query(MARKS + " SELECT session_id, component_id, state, idx, confidence FROM m")
def attributed_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marks(spark, sf_dir).select("session_id", "component_id", "state", "idx", "confidence")


@query(MARKS + " SELECT session_id, component_id, state, count(*) AS count, max(confidence) AS confidence FROM m GROUP BY session_id, component_id, state")
def session_usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.usages(_marks(spark, sf_dir)).drop("evidence")


@query(MARKS + " SELECT 'r' || c.r AS repo_id, 'hook:pre' AS component_id, count(*) - count(CASE WHEN k % 5 = 0 THEN 1 END) AS missed FROM c GROUP BY c.r")
def commits_without_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sessions commit; the hook ran in every fifth."""
    sessions = _owned(spark, sf_dir).withColumn("commits", F.lit(1))
    return attribution.missed_hooks(sessions, attribution.usages(_marks(spark, sf_dir)), components(spark))


@query("SELECT c_custkey AS session_id, 'hook:pre' AS component_id FROM customer WHERE c_custkey % 5 <> 0")
def session_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = _owned(spark, sf_dir).withColumn("commits", F.lit(1))
    return attribution.session_misses(sessions, attribution.usages(_marks(spark, sf_dir)), components(spark))


# --- reports over repositories that share ids: each counts its own sessions ---

CASES = """, k(repos, component_id, type, can_invoke, can_load) AS (VALUES ('012', 'command:go', 'command', true, false), ('01', 'skill:fmt', 'skill', true, true), ('1', 'skill:fmt@plugin', 'skill', true, true), ('02', 'skill:lint', 'skill', true, true), ('012', 'agent:scout', 'agent', true, false),
  ('0', 'server:db', 'server', true, false), ('012', 'hook:pre', 'hook', true, false), ('012', 'file:a', 'file', false, true), ('01', 'file:x', 'file', false, true), ('012', 'guide:root', 'guide', false, true), ('1', 'guide:src', 'guide', false, true)),
d AS (SELECT r, k.* FROM (SELECT unnest([0, 1, 2]) AS r), k WHERE contains(repos, CAST(r AS VARCHAR)))"""


def _started() -> Column:
    return F.date_add(F.lit("1996-06-01"), (nth() % 500).cast("int")).cast("timestamp")


@query(MARKS + CASES + """, s AS (SELECT session_id, r, k, CAST(DATE '1996-06-01' + CAST(k % 500 AS INTEGER) AS TIMESTAMP) AS started_at FROM c),
w AS (SELECT m.r, m.component_id, count(CASE WHEN state = 'invoked' THEN 1 END) AS invoked, count(CASE WHEN state = 'loaded' THEN 1 END) AS loaded, max(confidence) AS confidence, max(CASE WHEN state <> 'registered' THEN started_at END) AS last_used
  FROM m JOIN s ON s.session_id = m.session_id GROUP BY m.r, m.component_id),
y AS (SELECT r, count(*) FILTER (WHERE k % 5 <> 0) AS missed FROM s GROUP BY r),
t AS (SELECT d.*, coalesce(w.invoked, 0) AS invoked, coalesce(w.loaded, 0) AS loaded, w.confidence, w.last_used, CASE WHEN type = 'hook' THEN coalesce(y.missed, 0) ELSE 0 END AS missed, CASE WHEN can_invoke THEN coalesce(w.invoked, 0) ELSE coalesce(w.loaded, 0) END AS primary_count,
    coalesce(epoch(TIMESTAMP '1998-08-02') - epoch(w.last_used) > (epoch(TIMESTAMP '1998-08-02') - epoch(TIMESTAMP '1996-01-01')) * 2 / 3, false) AS stale, y.r IS NOT NULL AS seen
  FROM d LEFT JOIN w ON w.r = d.r AND w.component_id = d.component_id LEFT JOIN y ON y.r = d.r),
b AS (SELECT *, CASE WHEN NOT seen THEN 'no data' WHEN type = 'hook' THEN CASE WHEN invoked = 0 THEN 'never triggered' ELSE CASE WHEN primary_count <= 2 OR stale THEN 'low-use' ELSE 'active' END || CASE WHEN missed > 0 THEN ' (' || missed || ' MISS)' ELSE '' END END
    WHEN invoked + loaded = 0 THEN 'unused' WHEN primary_count <= 2 OR stale THEN 'low-use' ELSE 'active' END AS base FROM t)
SELECT 'r' || r AS repo_id, component_id, type, CAST(invoked AS BIGINT) AS invoked, CAST(loaded AS BIGINT) AS loaded, CAST(primary_count AS BIGINT) AS primary_count, last_used, CAST(missed AS BIGINT) AS missed, confidence,
  base || CASE WHEN NOT can_invoke AND invoked + loaded > 0 AND base <> 'never triggered' THEN ' (loaded)' ELSE '' END AS status FROM b""")
def repository_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of three repositories that share ids; hooks are missed in the commits of their own repository only."""
    from .session_queries import AS_OF, START

    sessions = _owned(spark, sf_dir).withColumn("k", F.col("session_id"))
    sessions = sessions.withColumns({"started_at": _started(), "commits": F.lit(1)})
    uses, own = attribution.usages(_marks(spark, sf_dir)), components(spark).where("NOT missing")
    return reports.window_report(sessions, uses, own, attribution.missed_hooks(sessions, uses, own), START, AS_OF)


@query(MARKS + CASES + """, n AS (SELECT m.session_id, m.component_id, count(CASE WHEN state = 'invoked' THEN 1 END) AS invoked, count(CASE WHEN state = 'loaded' THEN 1 END) AS loaded, max(confidence) AS confidence FROM m GROUP BY m.session_id, m.component_id)
SELECT c.session_id, 'r' || c.r AS repo_id, d.component_id, d.type, CASE WHEN n.invoked > 0 THEN 'invoked' WHEN n.loaded > 0 THEN 'loaded' ELSE 'registered' END AS state, n.invoked, n.loaded, CASE WHEN c.k % 4 = 0 THEN n.confidence ELSE 'heuristic' END AS confidence,
  d.type = 'hook' AND n.invoked = 0 AND c.k % 2 = 0 AS miss, CASE WHEN can_invoke THEN 'invoked' ELSE 'loaded' END AS most
FROM c JOIN d ON d.r = c.r JOIN n ON n.session_id = c.session_id AND n.component_id = d.component_id""")
def session_component_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every component of a session's repository; every second session commits, and every fourth is of a supported version."""
    sessions = _owned(spark, sf_dir).withColumn("k", F.col("session_id"))
    sessions = sessions.withColumns({"version": F.when(nth() % 4 == 0, "2.1.7").otherwise("2.0.9"), "commits": (nth() % 2 == 0).cast("int")})
    return reports.session_components(sessions, attribution.usages(_marks(spark, sf_dir)), components(spark))


# --- the timeline of sessions with subagents, failed calls and stale copies ---


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda p: F.concat(root(), F.lit(p))
    odd = nth() % 2 == 1
    used = lambda n: F.struct((F.lit(n) + nth()).alias("input"), F.lit(5).alias("output"), F.lit(0).alias("cache_creation"), F.lit(0).alias("cache_read"))
    return played(spark, sf_dir, [
        step(0, "user_msg", text="/review:go now"), step(1, "assistant_msg", text="on it", usage=used(1000)), step(2, "tool_use", "Read", {"file_path": at("/src/a.py")}, result="x" * 20), step(3, "tool_use", "Read", {"file_path": at("/docs/y.md"), "limit": "5"}, result="y" * 16),
        step(4, "tool_use", "Edit", {"file_path": at("/src/a.py")}, result="ok", failed=odd), step(5, "tool_use", "Bash", {"command": "cat docs/x.md docs/y.md\nls"}, result="z" * 40, cwd=root()), step(6, "tool_use", "Bash", {"command": "make"}, result="boom boom", failed=F.lit(True)),
        step(7, "tool_use", "Read", {"file_path": at("/docs/y.md")}, result="y" * 8, agent="scout"), step(8, "compaction", when=~odd), step(9, "assistant_msg", text="more", usage=used(2000)), step(10, "tool_use", "Edit", {"file_path": at("/docs/y.md")}, result="ok"),
        step(11, "tool_use", "Read", {"file_path": at("/docs/y.md")}, result="y" * 16), step(12, "tool_use", "Bash", {"command": "sleep 9"}),
    ])


@query("""WITH c AS (SELECT c_custkey AS session_id, c_custkey AS k, c_custkey % 3 AS r, c_custkey % 2 = 1 AS odd, length(CAST(c_custkey % 3 AS VARCHAR)) AS d FROM customer),
x(repos, half, ord, idx, kind, component_id, state, detail, confidence, tokens, sample, side) AS (VALUES
  ('012', 'eo', 1, -1, 'session_start', NULL, NULL, 'version ?', 'exact', 0, NULL, false), ('012', 'eo', 2, 0, 'guide', 'guide:root', 'loaded', 'always in context', 'exact', 10, NULL, false), ('012', 'eo', 3, 0, 'command', 'command:go', 'invoked', '/review:go', 'exact', 10, NULL, false),
  ('012', 'eo', 4, 4, 'file', 'file:a', 'loaded', 'src/a.py', 'exact', 5, 1000, false), ('012', 'eo', 5, 6, 'file_read', NULL, NULL, 'Read docs/y.md', 'exact', 4, 1000, false),
  ('012', 'e', 6, 8, 'action', NULL, NULL, 'src/a.py', 'exact', 5, 1000, false), ('012', 'o', 6, 8, 'action', NULL, NULL, 'src/a.py (failed)', 'exact', 5, 1000, false), ('1', 'eo', 7, 8, 'guide', 'guide:src', 'loaded', 'src/a.py', 'heuristic', 0, 1000, false),
  ('012', 'eo', 8, 10, 'action', NULL, NULL, 'cat docs/x.md docs/y.md ⏎ ls', 'exact', 7, 1000, false), ('01', 'eo', 9, 10, 'file', 'file:x', 'loaded', 'docs/x.md', 'heuristic', 5, 1000, false), ('2', 'eo', 9, 10, 'file_read', NULL, NULL, 'Bash docs/x.md', 'heuristic', 5, 1000, false), ('012', 'eo', 10, 10, 'file_read', NULL, NULL, 'Bash docs/y.md', 'heuristic', 5, 1000, false),
  ('012', 'eo', 11, 12, 'action', NULL, NULL, 'make (failed)', 'exact', 4, 1000, false), ('012', 'eo', 12, 14, 'file_read', NULL, NULL, '[subagent:scout] Read docs/y.md', 'exact', 2, NULL, true), ('012', 'e', 13, 16, 'compaction', NULL, NULL, 'compaction', 'exact', 0, NULL, false),
  ('012', 'eo', 14, 20, 'action', NULL, NULL, 'docs/y.md', 'exact', 5, 2000, false), ('012', 'o', 15, 20, 'stale_open', NULL, NULL, 'S1 docs/y.md: copy read at 10, overturned by Edit', 'heuristic', NULL, 2000, false), ('012', 'o', 16, 20, 'stale_open', NULL, NULL, 'S2 docs/y.md: copy read at 14, overturned by Edit', 'heuristic', NULL, NULL, true),
  ('012', 'e', 7.5, 8, 'stale_open', NULL, NULL, 'S1 src/a.py: copy read at 4, overturned by Edit', 'exact', NULL, 1000, false), ('012', 'e', 15, 20, 'stale_open', NULL, NULL, 'S2 docs/y.md: copy read at 14, overturned by Edit', 'heuristic', NULL, NULL, true), ('012', 'o', 17, 22, 'file_read', NULL, NULL, 'Read docs/y.md (closes S1)', 'exact', 4, 2000, false), ('012', 'e', 17, 22, 'file_read', NULL, NULL, 'Read docs/y.md', 'exact', 4, 2000, false),
  ('012', 'eo', 18, 24, 'action', NULL, NULL, 'sleep 9', 'exact', 2, 2000, false), ('012', 'eo', 19, 1000000000, 'session_end', NULL, NULL, NULL, 'exact', 0, 2000, false))
SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY ord) AS INTEGER) AS no, CAST(idx AS BIGINT) AS idx, kind, component_id, state, coalesce(detail, (3010 + 2 * k) || ' tokens') AS detail, confidence, CAST(tokens AS BIGINT) AS tokens, CAST(sample + k AS BIGINT) AS occupancy, side AS is_sidechain
FROM c JOIN x ON contains(repos, CAST(r AS VARCHAR)) AND contains(half, CASE WHEN odd THEN 'o' ELSE 'e' END)""")
def session_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, owned, found = written(_timed(spark, sf_dir), "events"), _owned(spark, sf_dir), components(spark).withColumn("tokens_est", F.lit(10).cast("long"))
    results, reads, marks = _attributed(events, found, owned, listed(spark, "docs/x.md", "docs/y.md", "src/a.py"))
    rows = written(timeline.entries(events, results, found, owned, marks, reads), "entries")
    stats = attribution.session_stats(events).withColumn("version", F.lit(None).cast("string"))
    stats = stats.withColumn("tokens", sum(F.col(f"{c}_tokens") for c in ("input", "output", "cache_creation", "cache_read")))
    copies = written(windows.stale_windows(stale.stale_ops(events, results, owned.select("session_id", "root"), said(events))), "stale")
    out = timeline.session_timeline(rows, windows.session_bounds(stats), copies, windows.context_samples(events))
    return out.select("session_id", "no", "idx", "kind", "component_id", "state", "detail", "confidence", "tokens", "occupancy", "is_sidechain")


@query("""WITH c AS (SELECT c_custkey AS session_id, c_custkey % 3 AS r FROM customer), x(repos, no, path, first_idx, loads, injected, reads, bash, confidence) AS (VALUES
  ('012', 1, 'CLAUDE.md', 0, 1, 1, 0, 0, 'exact'), ('012', 2, 'src/a.py', 4, 1, 0, 1, 0, 'exact'), ('012', 3, 'docs/y.md', 6, 3, 0, 2, 1, 'heuristic'), ('012', 4, 'docs/x.md', 10, 1, 0, 0, 1, 'heuristic'))
SELECT session_id, CAST(no AS INTEGER) AS no, path, CAST(first_idx AS BIGINT) AS first_idx, CAST(loads AS BIGINT) AS loads, CAST(injected AS BIGINT) AS injected, CAST(reads AS BIGINT) AS reads, CAST(bash AS BIGINT) AS bash, confidence FROM c JOIN x ON contains(repos, CAST(r AS VARCHAR))""")
def session_file_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in the main context; what the subagent read is not among them."""
    events, owned = written(_timed(spark, sf_dir), "events"), _owned(spark, sf_dir)
    results = written(transcripts.first_results(events), "results")
    reads = timeline.file_reads(events, results, owned, listed(spark, "docs/x.md", "docs/y.md"), components(spark), said(events))
    out = reports.file_loads(written(reads, "reads"))
    by = lambda tool: F.coalesce(F.try_element_at("by_tool", F.lit(tool)), F.lit(0))
    return out.select("session_id", "no", "path", "first_idx", "loads", by(timeline.INJECTED).alias("injected"), by("Read").alias("reads"), by("Bash").alias("bash"), "confidence")


# --- what sessions looked for, by mixed commands ---


def _searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda n: F.lit("x" * 4 * n)
    bash = lambda k, command, result: step(k, "tool_use", "Bash", {"command": command}, result=result)
    own = lambda before, after="": F.concat(F.lit(before), nth().cast("string"), F.lit(after))
    return played(spark, sf_dir, [
        bash(1, "tree a; tree b; grep -r widget src", text(12)), bash(2, "find . -type d -not -name x", text(10)), bash(3, "find d -type f", text(9)), bash(4, "find . -name '*Order*' -prune -o -type d", text(10)),
        bash(5, own("cat f | grep --include=*.py foo"), text(7)), bash(6, own("rg -r X needle", " src"), own("src/f", ".py")), bash(7, "fd -e py -x rm", text(3)), bash(8, "ps | grep -v java", text(3)), bash(9, "ls a", text(2)), bash(10, "ls b", text(3)),
        step(11, "tool_use", "Read", {"file_path": F.concat(root(), own("/src/f", ".py"))}, result=text(6), cwd=F.concat(root(), F.lit("/"))), step(12, "tool_use", "Grep", {"pattern": own("def |total")}, result=text(9)), bash(13, "cd x && ls p q; ls r", text(5)),
        step(14, "tool_use", "Glob", {"pattern": own("**/billing", "*.py")}, result=text(4)), bash(15, own("git grep -n 'Key", "'"), text(2)), step(16, "tool_use", "Bash", {"command": own("rg lost")}, result=text(8), failed=F.lit(True)),
    ])


@query("""WITH x(idx, kind, key, raw, tool, tokens_est, confidence) AS (VALUES (1, 'search', 'widget', 'widget', 'grep', 4, 'exact'), (1, 'mapping', 'repo layout', 'tree a', 'Bash', 8, 'exact'), (2, 'mapping', 'repo layout', 'find . -type d -not -name x', 'Bash', 10, 'exact'),
  (4, 'mapping', 'repo layout', 'find . -name ''*Order*'' -prune -o -type d', 'Bash', 10, 'exact'), (5, 'search', 'foo#', 'foo#', 'grep', 7, 'exact'), (6, 'search', 'needle#', 'needle#', 'rg', -1, 'exact'), (9, 'mapping', 'repo layout', 'ls chain', 'Bash', 5, 'heuristic'),
  (11, 'chain_read', 'needle#', 'src/f#.py', 'Read', 6, 'heuristic'), (12, 'mapping', 'code structure', 'def', 'Grep', 4, 'exact'), (12, 'search', 'total#', 'total#', 'Grep', 4, 'exact'), (13, 'mapping', 'repo layout', 'ls p q; ls r', 'Bash', 5, 'heuristic'),
  (14, 'search', 'billing#', '**/billing#*.py', 'Glob', 4, 'exact'), (15, 'search', 'key#', 'Key#', 'git grep', 2, 'exact'), (16, 'search', 'lost#', 'lost#', 'rg', 0, 'exact'))
SELECT c_custkey AS session_id, CAST(2 * idx AS BIGINT) AS idx, kind, replace(key, '#', CAST(c_custkey AS VARCHAR)) AS key, replace(raw, '#', CAST(c_custkey AS VARCHAR)) AS raw, tool,
  CAST(CASE WHEN tokens_est < 0 THEN ceil(length('src/f' || c_custkey || '.py') / 4.0) ELSE tokens_est END AS BIGINT) AS tokens_est, confidence FROM customer, x""")
def session_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = written(_searched(spark, sf_dir), "events")
    out = facts.extract(events, written(transcripts.first_results(events), "results"), _owned(spark, sf_dir), said(events))
    return out.select("session_id", "idx", "kind", "key", "raw", "tool", "tokens_est", "confidence")


@query("SELECT c_custkey AS session_id, CAST(85 + ceil(length('src/f' || c_custkey || '.py') / 4.0) AS BIGINT) + 8 AS tool_output_tokens FROM customer")
def tool_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.tool_output_tokens(_searched(spark, sf_dir))


# --- stale copies from calls ---


def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda p: F.concat(root(), F.lit(p))
    return played(spark, sf_dir, [
        step(1, "tool_use", "Read", {"file_path": "src/../a.py"}, result="x" * 20, cwd=root()), step(2, "tool_use", "Edit", {"file_path": at("/a.py")}, result="ok", failed=nth() % 2 == 1), step(3, "tool_use", "Bash", {"command": "cat ./a.py b.py"}, result="x" * 32, cwd=root()),
        step(4, "tool_use", "Bash", {"command": "git pull"}, result="done", cwd=root()), step(5, "compaction", when=nth() % 3 == 0), step(6, "tool_use", "Read", {"file_path": "/other/z.py"}, result="zzzz"), step(7, "tool_use", "Edit", {"file_path": "/other/z.py"}, result="ok"),
        step(8, "tool_use", "Read", {"file_path": at("/n.ipynb"), "limit": "5"}, result="x" * 8), step(9, "tool_use", "NotebookEdit", {"notebook_path": at("/n.ipynb")}, result="ok"), step(10, "tool_use", "Bash", {"command": "echo 1 > n.ipynb; cat n.ipynb"}, result="1", cwd=root()),
    ])


@query("""WITH c AS (SELECT c_custkey AS session_id, c_custkey % 2 = 0 AS edited, CASE WHEN c_custkey % 3 = 0 THEN 10 END AS left_at FROM customer),
s AS (
  SELECT session_id, 'a.py' AS path, 2 AS read_idx, 4 AS mutate_idx, 6 AS close_idx, 're-read' AS outcome, 5 AS tokens, 'Edit' AS mutate_tool, false AS partial, 'exact' AS confidence FROM c WHERE edited
  UNION ALL SELECT session_id, path, 6, 8, left_at, CASE WHEN left_at IS NULL THEN 'never-re-read' ELSE 'compacted' END, 4, 'git pull', false, 'heuristic' FROM c, (VALUES ('a.py'), ('b.py')) p(path)
  UNION ALL SELECT session_id, 'n.ipynb', 16, 18, 20, 're-read', 2, 'NotebookEdit', true, 'exact' FROM c
  UNION ALL SELECT session_id, 'n.ipynb', 20, 20, NULL, 'never-re-read', 1, 'echo', false, 'heuristic' FROM c
) SELECT session_id, path, CAST(read_idx AS BIGINT) AS read_idx, CAST(mutate_idx AS BIGINT) AS mutate_idx, CAST(close_idx AS BIGINT) AS close_idx, outcome, CAST(tokens AS BIGINT) AS read_tokens_est, mutate_tool, partial AS read_partial, confidence FROM s""")
def session_stale_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = written(_changed(spark, sf_dir), "events")
    ops = stale.stale_ops(events, written(transcripts.first_results(events), "results"), _owned(spark, sf_dir).select("session_id", "root"), said(events))
    return windows.stale_windows(written(ops, "ops")).select("session_id", "path", "read_idx", "mutate_idx", "close_idx", "outcome", "read_tokens_est", "mutate_tool", "read_partial", "confidence")


# --- the rest of what a sync writes, on orders ---


@query("""SELECT o_orderkey AS session_id, o_orderdate AS started_at, CASE WHEN o_orderkey % 4 = 0 THEN 'degraded' WHEN o_orderstatus = 'F' THEN 'degraded' ELSE 'ok' END AS parse_status, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS cost_usd FROM orders""")
def archive_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a start the change time of the transcript stands in, without health the session counts as degraded."""
    from loomline.sources import archive

    o, k = table(spark, sf_dir, "orders"), F.col("session_id")
    units = o.select(F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").alias("modified"))
    stats = o.select(F.col("o_orderkey").alias("session_id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate")).alias("started_at"), F.lit(None).cast("timestamp_ntz").alias("ended_at"))
    health = o.select(F.col("o_orderkey").alias("session_id"), F.when(F.col("o_orderstatus") == "F", "degraded").otherwise("ok").alias("parse_status")).where(k % 4 != 0)
    costs = o.select(F.col("o_orderkey").alias("session_id"), F.col("o_totalprice").alias("cost_usd")).where(k % 2 == 0)
    return archive.session_rows(stats, health, units, costs).select("session_id", "started_at", "parse_status", "cost_usd")


@query("""SELECT l_orderkey AS session_id, l_linenumber AS idx, CASE WHEN l_orderkey % 3 = 0 THEN 'exact' ELSE 'heuristic' END AS confidence FROM lineitem""")
def version_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a version that is not supported are sure of nothing."""
    from loomline.sources import archive

    k = F.col("session_id")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("idx"), F.lit("exact").alias("confidence"))
    health = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id")).withColumn("version", F.when(k % 3 == 0, F.format_string("2.1.%d", k)).when(k % 3 == 1, "2.0.1"))
    return archive.unsure_if_unsupported(rows, health)


@query("""SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, CAST(json_extract(props, '$.k') AS BIGINT) * 3 AS tokens FROM events QUALIFY event_type = 'click' AND CAST(json_extract(props, '$.k') AS BIGINT) % 4 <> 0 AND CAST(json_extract(props, '$.k') AS BIGINT) > 0""")
def context_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the main chain held at each answer: answers of subagents and those without usage give none."""
    from .session_queries import session_events

    e = session_events(spark, sf_dir)
    usage = F.struct(nth().alias("input"), F.lit(1).cast("long").alias("output"), nth().alias("cache_creation"), nth().alias("cache_read"))
    answers = e.select("session_id", "idx", F.when(F.col("event_type") == "click", "assistant_msg").otherwise("other").alias("kind"), (nth() % 4 == 0).alias("is_sidechain"), usage.alias("usage"))
    return windows.context_samples(answers)


@query("""SELECT o_orderkey AS session_id, CASE WHEN o_orderkey % 3 = 0 THEN 'review' WHEN o_orderkey % 3 = 1 THEN 'go' || o_orderkey END AS command, 'd' || o_orderkey || '/x.py' AS path FROM orders""")
def commands_and_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    said = F.when(k % 3 == 0, F.lit(" <command-name>/review</command-name> then")).when(k % 3 == 1, F.format_string("/go%d now", k)).otherwise(F.lit("see /go"))
    path = T.relative_path(F.format_string("/w/r/d%d/x.py", k), F.lit("/w/r"))
    return table(spark, sf_dir, "orders").select(k.alias("session_id"), T.command_name(said).alias("command"), path.alias("path"))
