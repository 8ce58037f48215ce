"""Guidance graph, inventory and attribution on small hand-made tables."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.operators import attribution, guidance, inventory, reports, shell

FILES = [
    ("CLAUDE.md", "# Map\nSee `src/a.py`, [b](src/b.py) and tests/*.py.\nGone: src/none.py\nunique: only.py\n@docs/more.md\n```\nignored/x.py `src/c.py`\n```\n"),
    ("src/CLAUDE.md", "- ../docs/deep.md\n- ../docs/deep.md again\n"), ("src/a.py", "def f():\n    pass\n"), ("src/b.py", "class A:\n    def g(self): ...\n"), ("src/c.py", "def ("),
    ("tests/t1.py", "x = 1"), ("tests/t2.py", ""), ("lib/only.py", ""), ("docs/more.md", "plain\n@deep.md"), ("docs/deep.md", "end"), (".git/config", "x"), ("dist/out.js", "x"),
]


@pytest.fixture(scope="module")
def graph(spark):
    files = spark.createDataFrame([("r", p, t) for p, t in FILES] + [("other", "CLAUDE.md", "src/a.py")], "repo_id string, path string, text string")
    index = guidance.file_index(files).cache()
    carriers = files.where("path LIKE '%.md'").select("repo_id", F.col("path").alias("carrier"), "text")
    edges, dead = guidance.references(guidance.candidates(carriers), index, files)
    return files, index, carriers, edges.cache(), dead.cache()


def test_index(graph):
    got = {(r.path, r.is_dir) for r in graph[1].where("repo_id = 'r'").collect()}
    assert ("src", True) in got and ("lib/only.py", False) in got and not any(p.startswith((".git", "dist")) for p, _ in got)


def test_references(graph):
    _, _, _, edges, dead = graph
    got = {(r.carrier, r.target, r.context, r.confidence) for r in edges.where("repo_id = 'r'").collect()}
    assert {("CLAUDE.md", "src/a.py", "inline", "exact"), ("CLAUDE.md", "src/b.py", "link", "exact"), ("CLAUDE.md", "tests/t1.py", "prose", "exact"), ("CLAUDE.md", "tests/t2.py", "prose", "exact")} <= got
    assert ("CLAUDE.md", "lib/only.py", "prose", "heuristic") in got and ("src/CLAUDE.md", "docs/deep.md", "prose", "exact") in got and ("CLAUDE.md", "src/c.py", "fenced", "exact") in got
    assert {(r.carrier, r.raw) for r in dead.where("repo_id = 'r'").collect()} >= {("CLAUDE.md", "src/none.py")}
    assert [r.raw for r in dead.where("repo_id = 'other'").collect()] == ["src/a.py"]


def test_reach_and_coverage(graph, tmp_path):
    files, index, _, edges, dead = graph
    starts = index.where("path = 'CLAUDE.md'").select("repo_id", F.col("path").alias("node"))
    links = edges.where("context <> 'fenced'").select("repo_id", F.col("carrier").alias("source"), "target", F.lit("reference").alias("kind"))
    got = guidance.reach(starts, links.unionByName(guidance.listing(index)), guidance.guide_chain(index), str(tmp_path / "x")).where("repo_id = 'r'")
    hops = {r.node: (r.hop, r.kind) for r in got.collect()}
    assert hops["CLAUDE.md"] == (0, "start") and hops["src/a.py"] == (1, "reference") and hops["src/CLAUDE.md"] == (1, "chain") and hops["docs/deep.md"][0] == 2 and "src/c.py" not in hops
    cover = guidance.coverage(index, got, guidance.symbol_counts(files), index.select("repo_id", "path", F.lit(3).alias("tokens"), F.lit(1).alias("searches")))
    r = guidance.map_rollup(cover).where("repo_id = 'r'").first()
    assert (r.code_files, r.symbols, r.reached_symbols, r.unparsed) == (6, 3, 3, 1)
    audited = starts.where("repo_id = 'r'")
    none = index.limit(0).select("repo_id", F.col("path").alias("carrier"), F.col("path").alias("target"))
    assert {x.raw for x in guidance.dead_routes(dead, got, audited, none).collect()} >= {"src/none.py"}
    assert {x.node for x in guidance.lazy_references(edges.where("repo_id = 'r'"), audited).collect()} == {"docs/deep.md"} | {x.target for x in edges.where("repo_id = 'r' AND target = 'docs/more.md'").collect()}


def test_lines_imports_and_routes(graph, tmp_path):
    _, index, carriers, _, _ = graph
    lines = guidance.classified_lines(carriers.where("repo_id = 'r'"))
    kinds = [r.kind for r in lines.where("carrier = 'CLAUDE.md'").orderBy("line_no").collect()]
    assert kinds == ["heading", "prose", "prose", "prose", "prose", "code", "code", "code"]
    found = guidance.candidates(lines.where("kind NOT IN ('code', 'blank')").select("repo_id", "carrier", "line_no", "text"))
    edges, _ = guidance.references(found, index, index)
    per_line = found.join(edges.select("repo_id", "carrier", "raw", "target"), ["repo_id", "carrier", "raw"]).select("repo_id", "carrier", "line_no", "target").distinct()
    kinds = {r.line_no: r.kind for r in guidance.routed(lines, per_line).where("carrier = 'CLAUDE.md'").collect()}
    assert kinds[2] == "routing" and kinds[1] == "heading"
    assert [(r.carrier, r.target) for r in guidance.duplicate_routes(per_line).collect()] == [("src/CLAUDE.md", "docs/deep.md")]
    links = guidance.imports(lines)
    assert {(r.carrier, r.target) for r in links.collect()} == {("CLAUDE.md", "docs/more.md"), ("docs/more.md", "docs/deep.md")}
    starts = index.where("repo_id = 'r' AND path = 'CLAUDE.md'").select("repo_id", F.col("path").alias("node"))
    assert guidance.import_closure(starts, links).count() == 3 and guidance.import_closure(starts, links, 1).count() == 2


def test_label_quality(spark):
    rows = [("- src/a.py", ["src/a.py"], ["src/a.py"]), ("the src a: src/a.py", ["src/a.py"], ["src/a.py"]), ("orders: src/a.py", ["src/a.py"], ["src/a.py"])]
    df = spark.createDataFrame(rows, "t string, r array<string>, p array<string>")
    assert [r.q for r in df.select(guidance.label_quality(F.col("t"), F.col("r"), F.col("p")).alias("q")).collect()] == ["bare", "said", "said"]


def test_inventory(spark):
    settings = {"hooks": {"PreToolUse": [{"matcher": "Bash", "hooks": [{"command": "c"}]}, {"matcher": "Bash", "hooks": [{"command": "c"}]}], "Stop": [{"hooks": [{"command": "d"}]}]}}
    files = spark.createDataFrame([
        ("r", ".claude/skills/k/SKILL.md", "---\nname: k\n---\nbody"), ("r", ".claude/commands/x/y.md", "c"), ("r", ".claude/agents/z.md", "a"), ("r", "CLAUDE.md", "g"), ("r", "sub/dir/CLAUDE.md", "g"),
        ("r", ".claude/settings.json", json.dumps(settings)), ("r", ".mcp.json", '{"mcpServers": {"srv": {"command": "x"}}}'), ("bad", ".claude/settings.json", "{"),
    ], "repo_id string, path string, text string")
    rows = {r.id: r for r in inventory.scan(files).collect()}
    assert {"skill:k", "command:x:y", "agent:z", "guide:root", "guide:sub-dir", "server:srv"} <= set(rows) and len(rows) == 9
    hooks = [r for r in rows.values() if r.type == "hook"]
    assert sorted(r.miss_when or "" for r in hooks) == ["", "git_commit", "git_commit"] and len({r.name for r in hooks}) == 3
    assert (rows["skill:k"].tokens_meta_est, rows["guide:root"].context, rows["guide:sub-dir"].context) == (3, "static", "dynamic")
    named = spark.createDataFrame([("skill:a@plugin-2", None), ("skill:b", "c")], "id string, name string")
    assert [r.name for r in inventory.with_names(named).collect()] == ["a", "c"]
    on = spark.createDataFrame([("p",)], "plugin string")
    own = spark.createDataFrame([("p", "i"), ("q", "j")], "plugin string, id string")
    assert [(r.id, r.source) for r in inventory.plugin_components(on, on, own).collect()] == [("i", "plugin:p")]


def test_attribution(spark):
    """Two repositories with the same ids: what a session does meets its own repository's components only."""
    e = spark.createDataFrame([("s", "r", 0, 0, "user_msg", "Base directory for this skill: /r/.claude/skills/k/\nrest"), ("s", "r", 1, 0, "user_msg", "hello"), ("t", "q", 0, 0, "user_msg", "hi")], "session_id string, repo_id string, idx long, seq int, kind string, text string")
    own = [("skill:k", "skill", "k", ".claude/skills/k/SKILL.md", "dynamic", False), ("skill:k2", "skill", "k", "other/k/SKILL.md", "dynamic", False), ("guide:root", "guide", "root", "CLAUDE.md", "static", False)]
    c = spark.createDataFrame([("r", *x) for x in own] + [("q", *own[2]), ("q", "skill:q", "skill", "k", "q/k/SKILL.md", "dynamic", True)], "repo_id string, id string, type string, name string, path string, context string, missing boolean")
    assert [(r.component_id, r.confidence) for r in attribution.expanded_skills(e, c).collect()] == [("skill:k", "exact")]
    first = attribution.first_events(e, e.select("session_id", "repo_id").distinct())
    assert sorted((r.session_id, r.component_id) for r in attribution.always_loaded(first, c).collect()) == [("s", "guide:root"), ("t", "guide:root")] and attribution.registered(first, c).count() == 4
    reads = e.where("session_id = 's' AND idx = 1").select("session_id", "idx", "seq", "repo_id", F.lit("CLAUDE.md").alias("path"))
    assert attribution.loaded_by_path(reads, c, "heuristic").count() == 1 and attribution.loaded_by_path(reads.withColumn("repo_id", F.lit("x")), c).count() == 0
    assert [r.component_id for r in attribution.skill_file_reads(reads.withColumn("path", F.lit("x/k/SKILL.md")), c).orderBy("component_id").collect()] == ["skill:k", "skill:k2"]


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.command_name(F.lit(" <command-name>/a:b</command-name> rest"))) == "a:b" and one(T.command_name(F.lit("/go now"))) == "go" and one(T.command_name(F.lit("see /go"))) is None
    assert one(T.canonical_key(F.lit(r"\bfoo_Bar{1,2}"))) == "foobar" and one(T.canonical_key(F.lit("Ab "))) == "ab" and one(T.canonical_key(F.lit("检索引擎"))) == "检索引擎"
    assert one(T.agent_tagged(F.lit("d\x1b[0m"), F.lit(True), F.lit("q"))) == "[subagent:q] d" and one(T.boilerplate(F.lit("<x>"))) and not one(T.boilerplate(F.lit(" x")))
    assert [one(T.short_number(F.lit(n))) for n in (999, 1000, 1250, 2_000_000)][3] == "2M"
    c = one(T.syntax_class(F.lit("src/**/*.py"), F.lit(True)))
    assert (c.structure, c.confidence) == (True, "exact") and one(T.syntax_class(F.lit("**/billing*.py"), F.lit(True))).keyword == "billing" and one(T.syntax_class(F.lit("use it for all"), F.lit(False))).structure is False
    assert one(T.path_under(F.lit("../x"), F.lit("/r"))) is None and one(T.path_under(F.lit("a/./b/../c"), F.lit("/r"))) == "a/c"


@pytest.mark.parametrize(("command", "reads", "changes"), [
    ("cat a b | head -n 5 c", ["5", "a", "b", "c"], []), ("grep -A 3 pat f.txt", ["f.txt"], []), ("grep -e pat f.txt", ["f.txt"], []), ("echo x > out; sed -i s/a/b/ f", [], [("out", "echo"), ("f", "sed")]),
    ("git checkout -b new", [], []), ("git -C d pull && rm -f y", [], [(None, "git pull"), ("y", "rm")]), ("echo 'a; rm b'", [], []), ("cat 'open", [], []), ("cat $HOME/x *.md", [], []), ("tee -a log.txt\nmv p q", [], [("log.txt", "tee"), ("p", "mv"), ("q", "mv")]),
])
def test_shell(spark, command, reads, changes):
    """A value of a flag of head may look like a path; the join with the files that exist drops it."""
    segs = shell.segments(spark.createDataFrame([(command,)], "command string"))
    assert sorted(r.path for r in shell.read_paths(segs).collect()) == sorted(reads)
    assert sorted(((r.path, r.label) for r in shell.mutations(segs).collect()), key=str) == sorted(changes, key=str)


def test_since_and_lookup(spark):
    now = datetime.datetime(2026, 3, 1, tzinfo=datetime.UTC)
    assert reports.since("2w", now) == datetime.datetime(2026, 2, 15, tzinfo=datetime.UTC) and reports.since("2026-01-02", now).day == 2
    s = spark.createDataFrame([("abc",), ("abd",)], "session_id string")
    assert reports.by_prefix(s, "abc").count() == 1
    for prefix in ("ab", "x"):
        with pytest.raises(LookupError):
            reports.by_prefix(s, prefix)


def test_reach_has_no_limit_of_its_own(spark, tmp_path):
    import inspect

    edges = spark.createDataFrame([("r", str(k), str(k + 1), "reference") for k in range(6)], "repo_id string, source string, target string, kind string")
    starts = spark.createDataFrame([("r", "0")], "repo_id string, node string")
    assert inspect.signature(guidance.reach).parameters["most"].default is None  # a chain of over 1000 hops takes minutes
    assert guidance.reach(starts, edges, folder=str(tmp_path / "all")).count() == 7
    assert guidance.reach(starts, edges, folder=str(tmp_path / "two"), most=2).count() == 3
