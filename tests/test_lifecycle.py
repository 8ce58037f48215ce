"""Transcript files to archive to reports, and the shell rules that decide what a command looked for."""

import datetime
import json

import pytest

from loomline.operators import guidance, lifecycle, shell, windows
from loomline.plans.lifecycle_queries import components
from loomline.sources import archive, transcripts
from loomline.streaming import live
from tests.test_graph_and_registry import graph  # noqa: F401


@pytest.mark.parametrize(("command", "found"), [
    ("tree a; tree b; grep -r widget src", [("grep", "widget"), ("tree a", None), ("tree b", None)]), ("find d -type f", []), ("find . -type d -not -name x", [("find . -type d -not -name x", None)]),
    ("find . -name a -o -iname 'b c'", [("find", "a"), ("find", "b c")]), ("find . ! -name a -name b", [("find", "b")]), ("find . -path ./x -prune -o -type d", [("find . -path ./x -prune -o -type d", None)]), ("find . -not -type d", []),
    ("cat f | grep --include=*.py foo", [("grep", "foo")]), ("cat f | grep foo", []), ("cat f | grep foo g.py", [("grep", "foo")]), ("cat f | grep -rn foo", [("grep", "foo")]), ("cat f | rg -r X foo", []), ("rg -r X foo", [("rg", "foo")]),
    ("grep -v foo a", []), ("grep -inv foo a", []), ("grep -A 3 foo a", [("grep", "foo")]), ("grep -e foo -e bar a", [("grep", "foo")]), ("grep -f list a", []), ("grep --file list a", []), ("grep -A -v foo", [("grep", "foo")]), ("egrep 'a b' x", [("egrep", "a b")]), ("ag foo", [("ag", "foo")]),
    ("git grep -n foo", [("git grep", "foo")]), ("git log", []), ("fd -e py foo", [("fd", "foo")]), ("fd -x rm", []), ("fd foo -x rm", [("fd", "foo")]), ("fd --size +1k foo", [("fd", "foo")]), ("fd -d 2 foo src", [("fd", "foo")]),
    ("ls a; ls 'b c'", [("ls a; ls 'b c'", None)]), ("ls a", []), ("cd x && tree", [("tree", None)]), ("echo 'open", []),
])
def test_what_commands_look_for(spark, command, found):
    """Patterns by who searches; layouts as they were written."""
    from pyspark.sql import functions as F

    got = shell.digest(shell.segments(spark.createDataFrame([(command,)], "command string"))).select(F.inline("items")).orderBy("seg_no", "probe_no").collect()
    assert sorted(((r.layout or r.label, r.pattern) for r in got), key=str) == sorted(found, key=str)


def transcript(*rows):
    return "\n".join(json.dumps({"timestamp": "2026-01-01T00:00:0%dZ" % k, "version": "2.1.3", "cwd": "/w/r0", **r}) for k, r in enumerate(rows))


def answer(tool, given, n):
    return {"type": "assistant", "message": {"model": "m-1", "usage": {"input_tokens": 100, "output_tokens": 10}, "content": [{"type": "tool_use", "id": f"t{n}", "name": tool, "input": given}]}}


def result(text, n):
    return {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": f"t{n}", "content": text}]}}


AS_OF = datetime.datetime(2026, 1, 3, tzinfo=datetime.UTC)


def registry_of(spark):
    """Three repositories that share ids, each with ten tokens always in context."""
    from pyspark.sql import functions as F

    repos = spark.createDataFrame([(f"r{k}", f"/w/r{k}") for k in range(3)], "repo_id string, root string")
    files = spark.createDataFrame([("r0", "src/a.py"), ("r0", "docs/y.md")], "repo_id string, path string")
    prices = spark.createDataFrame([("m", 1.0, 2.0)], "prefix string, in_usd double, out_usd double")
    return lifecycle.Registry(components(spark).withColumn("tokens_est", F.lit(10).cast("long")), repos, files, prices)


def session_lines():
    ask = {"type": "user", "cwd": "/w/r0", "message": {"content": "do it"}}
    return [
        ask, answer("Bash", {"command": "grep -rn needle src"}, 1), result("src/a.py: needle", 1), answer("Read", {"file_path": "/w/r0/src/a.py"}, 2), result("text", 2), answer("Edit", {"file_path": "/w/r0/src/a.py"}, 3), result("ok", 3),
        answer("Bash", {"command": "git commit -m x; cat docs/y.md"}, 4), result("[main 1a2b3c4d] x", 4), answer("Read", {"file_path": "/w/r0/src/a.py"}, 5)]


def write_sessions(src):
    """One whole session with a subagent, one in another repository, one of broken lines."""
    src.mkdir()
    (src / "s1.jsonl").write_text(transcript(*session_lines()) + "\n" + transcript(result("text", 5)))
    (src / "s1/subagents").mkdir(parents=True)
    (src / "s1/subagents/agent-q.jsonl").write_text(transcript(answer("Read", {"file_path": "/w/r0/docs/y.md"}, 8), result("text", 8)))
    ask = {"type": "user", "cwd": "/w/r1", "message": {"content": "do it"}}
    (src / "s2.jsonl").write_text(transcript(ask, answer("Read", {"file_path": "/w/r1/CLAUDE.md"}, 1), result("text", 1), {"type": "odd"}) + "\n{broken")
    (src / "s3.jsonl").write_text("{broken\n[1]")


def test_sync_and_reports(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "archive")
    write_sessions(src)
    registry = registry_of(spark)
    first = lifecycle.sync(spark, str(src), out, registry).first()
    assert (first.new, first.updated, first.skipped, first.degraded) == (3, 0, 0, 2)
    again = lifecycle.sync(spark, str(src), out, registry).first()
    assert (again.new, again.updated, again.skipped) == (0, 0, 3)
    assert {(r.session_id, r.line_no) for r in archive.current(spark, out, "quarantine").collect()} == {("s2", 4), ("s3", 0), ("s3", 1)}

    one = lifecycle.session_report(spark, out, registry, "s1")
    row = one["session"].first()
    assert (row.repo_id, row.turns, row.commits, row.parse_status) == ("r0", 1, 1, "ok") and row.cost_usd > 0
    assert row.static_usd == pytest.approx(row.cost_usd * 10 / 100)  # ten tokens of the session's own repository in a context of a hundred
    states = {r.component_id: (r.state, r.miss) for r in one["components"].collect()}
    assert states["file:a"] == ("loaded", False) and states["guide:root"] == ("loaded", False) and states["skill:fmt"] == ("registered", False) and states["hook:pre"] == ("registered", True) and "skill:fmt@plugin" not in states
    loads = [(r.no, r.path, r.loads, r.confidence, r.by_tool) for r in one["file_loads"].collect()]
    assert sorted(loads) == [(1, "CLAUDE.md", 1, "exact", {"system-injected": 1}), (2, "src/a.py", 2, "exact", {"Read": 2}), (3, "docs/y.md", 1, "heuristic", {"Bash": 1})]
    rows = one["timeline"].collect()
    assert [r.no for r in rows] == list(range(1, len(rows) + 1)) and (rows[0].kind, rows[0].detail, rows[-1].kind) == ("session_start", "version 2.1.3", "session_end")
    told = [(r.kind, r.state, r.detail, r.tokens) for r in rows[1:-1]]
    assert ("guide", "loaded", "always in context", 10) == told[0] and ("action", None, "grep -rn needle src", 5 + 4) in told and ("file", "loaded", "src/a.py", 1) in told
    assert ("action", None, "git commit -m x; cat docs/y.md", 8) in told and ("file_read", None, "Bash docs/y.md", 5) in told and ("file_read", None, "[subagent:q] Read docs/y.md", 1) in told
    held = {r.detail: r.occupancy for r in rows}
    assert held["[subagent:q] Read docs/y.md"] is None and held["src/a.py"] == 100 and rows[-1].occupancy == 100
    assert [r.detail for r in rows if r.kind == "stale_open"] == ["S1 src/a.py: copy read at 4, overturned by Edit"] or len([r for r in rows if r.kind == "stale_open"]) == 1
    assert [(r.stale_no, r.path, r.outcome) for r in one["stale_copies"].collect()] == [(1, "src/a.py", "re-read")]
    assert {r.lane for r in one["bins"].collect()} == {"load", "act"} and one["static_total"].first().static_tokens == 10 and [r.id for r in one["static"].collect()] == ["guide:root"]
    assert {r.key for r in one["needs"].collect()} == {"needle"} and [r.component_id for r in one["missed"].collect()] == ["hook:pre"]

    window = lifecycle.window_report(spark, out, registry, "30d", AS_OF)
    own = {(r.repo_id, r.component_id): r for r in window["components"].collect()}
    assert len(own) == registry.components.where("NOT missing").count()
    assert (own["r0", "guide:root"].loaded, own["r1", "guide:root"].loaded, own["r2", "guide:root"].loaded) == (1, 2, 0)
    assert own["r2", "guide:root"].status == "no data" and own["r1", "file:a"].status == "unused" and own["r0", "file:a"].status == "low-use (loaded)"
    assert (own["r0", "hook:pre"].missed, own["r1", "hook:pre"].missed) == (1, 0)
    assert window["coverage"].first().sessions == 3 and {r.code: r.n for r in window["warnings"].collect()}["degraded"] == 2

    (src / "s2.jsonl").write_text(transcript({"type": "user", "cwd": "/w/r1", "message": {"content": "again"}}))
    third = lifecycle.sync(spark, str(src), out, registry).first()
    assert (third.new, third.updated, third.skipped, third.degraded) == (0, 1, 2, 0)
    assert {(r.session_id, r.line_no) for r in archive.current(spark, out, "quarantine").collect()} == {("s3", 0), ("s3", 1)}


def test_live_ingest_equals_sync(spark, tmp_path):
    """A session that comes in two batches, one of them twice, stands in the archive as one that was read whole."""
    src, live_at, whole = tmp_path / "src", str(tmp_path / "live"), str(tmp_path / "whole")
    src.mkdir()
    (src / "s1.jsonl").write_text(transcript(*session_lines()))
    registry = registry_of(spark)
    lifecycle.sync(spark, str(src), whole, registry)
    lines = transcripts.transcript_lines(transcripts.read_files(spark, str(src)))
    write = live.ingest_writer(live_at, registry)
    for number, bounds in enumerate(["line_no < 5", "line_no >= 5"]):
        write(lines.where(bounds), number)
    write(lines.where("line_no >= 5"), 1)
    assert archive.committed(spark, live_at) == [0, 1]
    for name, volatile in [("uses", []), ("facts", []), ("stale", []), ("timeline", []), ("reads", []), ("samples", []), ("sessions", ["modified", "size", "files"])]:
        assert archive.snapshot(archive.current(spark, live_at, name), volatile) == archive.snapshot(archive.current(spark, whole, name), volatile), name


def test_guidance_map(spark, graph, tmp_path):  # noqa: F811
    from loomline.operators import routemap

    files = spark.createDataFrame([
        ("r", "CLAUDE.md", "# Map\n- code: src/a.py\n- src/a.py\n@docs/one.md\n@~/mine.md and @else/where.md\nGone: src/gone.py\n"), ("r", "docs/one.md", "read @docs/two.md or @three.md\nsrc/lost.py"), ("r", "docs/two.md", "end"), ("r", "docs/three.md", "x"),
        ("r", "docs/four.md", "@docs/five.md"), ("r", "docs/five.md", "y"), ("r", "src/CLAUDE.md", "see docs/four.md\n"), ("r", "src/a.py", "def f(): pass"), ("r", "lib/b.py", "x = 1"), ("q", "a.py", "x = 1")], "repo_id string, path string, text string")
    got = routemap.guidance_map(files, folder=str(tmp_path / "reach"))
    assert {(r.carrier, r.loading) for r in got["carriers"].collect()} == {("CLAUDE.md", "auto-inject"), ("src/CLAUDE.md", "dir-entry"), ("docs/one.md", "import"), ("docs/two.md", "import"), ("docs/three.md", "import")}
    root = next(r for r in got["carriers"].collect() if r.carrier == "CLAUDE.md")
    assert (root.routing, root.bare, root.heading) == (2, 1, 1)
    assert {(r.carrier, r.raw) for r in got["imports_external"].collect()} == {("CLAUDE.md", "~/mine.md"), ("CLAUDE.md", "else/where.md")}
    assert {(r.carrier, r.raw) for r in got["dead_routes"].collect()} == {("CLAUDE.md", "src/gone.py"), ("docs/one.md", "src/lost.py"), ("docs/four.md", "@docs/five.md")}  # imports of either base are none, but only carriers import
    total = {r.repo_id: r for r in got["totals"].collect()}
    assert total["r"].resident_tokens == sum(r.tokens for r in got["carriers"].collect() if r.loading != "dir-entry") and (total["r"].root_present, total["q"].root_present, total["q"].carriers) == (True, False, 0)
    assert {r.node for r in got["lazy"].collect()} == {"docs/four.md"} and [(r.carrier, r.target, r.lines) for r in got["duplicates"].collect()] == [("CLAUDE.md", "src/a.py", 2)]
    assert {r.path for r in got["unreached"].collect()} == {"lib/b.py", "a.py"} and got["imports_beyond"].count() == 0


def test_session_bounds(spark):
    stats = spark.createDataFrame([("s", "2.1.3", 7), ("t", None, None)], "session_id string, version string, tokens long")
    rows = spark.createDataFrame([("s", 4, 0, "action", "x")], "session_id string, idx long, seq int, kind string, detail string")
    got = windows.timeline([rows, windows.session_bounds(stats)]).orderBy("session_id", "no").collect()
    assert [(r.session_id, r.detail) for r in got] == [("s", "version 2.1.3"), ("s", "x"), ("s", "7 tokens"), ("t", "version ?"), ("t", "0 tokens")]


def test_imports_outside_and_too_deep(spark, graph, tmp_path):  # noqa: F811
    from pyspark.sql import functions as F

    links = spark.createDataFrame([("r", "CLAUDE.md", "docs/more.md"), ("r", "docs/more.md", "docs/deep.md"), ("r", "CLAUDE.md", "gone.md")], "repo_id string, carrier string, target string")
    edges, outside = guidance.resolved_imports(links, graph[1])
    assert [r.target for r in outside.collect()] == ["gone.md"] and edges.count() == 2
    starts = graph[1].where("repo_id = 'r' AND path = 'CLAUDE.md'").select("repo_id", F.col("path").alias("node"))
    assert [r.node for r in guidance.imports_beyond(starts, edges, 1).collect()] == ["docs/deep.md"] and guidance.imports_beyond(starts, edges, 2).count() == 0


def test_searched_though_reached(spark):
    cover = spark.createDataFrame([("r", "a.py", 1, 5, 2, 1, True), ("r", "b.py", 1, 9, 1, 2, True), ("r", "c.py", 1, 0, 0, 1, True), ("r", "d.py", None, 9, 1, None, False)], "repo_id string, path string, defs long, tokens long, searches long, hop int, reachable boolean")
    assert [r.path for r in guidance.searched_though_reached(cover).collect()] == ["b.py", "a.py"] and [r.path for r in guidance.unreached(cover).collect()] == ["d.py"]


@pytest.mark.parametrize("text", ["", "a", "```", "a\n```\nb\n```\nc\n```\nd", "```x\n```\n```\n", "\n\n", "a\r\n ```\r\nb"])
def test_lines_against_a_plain_walk(spark, text):
    got = [(r.line_no, r.kind == "code") for r in guidance.classified_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("line_no").collect()]
    inside, want = False, []
    for no, line in enumerate((text.removesuffix("\r\n") if text.endswith("\r\n") else text.removesuffix("\n")).replace("\r\n", "\n").split("\n"), 1):
        mark = line.strip().startswith("```")
        want.append((no, inside or mark))
        inside ^= mark
    assert got == want
