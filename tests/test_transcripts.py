"""Parsing of transcripts written by hand: every line type, broken lines, subagents."""

import json

import pytest

from loomline.operators import attribution, facts, windows
from loomline.sources import archive, transcripts

LINES = [
    {"type": "user", "timestamp": "2026-01-01T00:00:00Z", "cwd": "/r", "version": "2.1.3", "message": {"content": "hello"}},
    {"type": "assistant", "timestamp": "2026-01-01T00:00:01+00:00", "message": {"model": "m-1", "usage": {"input_tokens": 5, "output_tokens": None}, "content": [
        {"type": "text", "text": "a"}, {"type": "text", "text": "b"}, {"type": "tool_use", "id": "t1", "name": "Read", "input": {"file_path": "/r/x"}}, {"type": "tool_use", "id": "t2", "name": "Bash", "input": {"command": "ls"}}]}},
    {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "out"}]}, {"type": "tool_result", "tool_use_id": "t2", "content": "err", "is_error": True}]}},
    {"type": "system", "subtype": "stop_hook_summary", "hookInfos": [{"command": "c1"}, {"command": "c2"}]},
    {"type": "system", "subtype": "compact_boundary"},
    {"type": "user", "isCompactSummary": True, "message": {"content": "sum"}},
    {"type": "summary", "summary": "S"},
    {"type": "attachment", "attachment": {"type": "hook_x", "hookName": "PreToolUse:Bash"}},
    {"type": "mode"},
    {"type": "weird"},
    {"type": "user", "message": {"content": []}},
]


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sessions")
    (d / "s2/subagents").mkdir(parents=True)
    text = lambda rows: "\n".join(json.dumps(x) for x in rows)
    (d / "s1.jsonl").write_text(text(LINES[:3]) + "\n\n{bad\n[1]\n" + text(LINES[3:]))
    (d / "s2.jsonl").write_text(text(LINES[:2]))
    (d / "s2/subagents/agent-q.jsonl").write_text(text(LINES[:2]))
    (d / "s2/subagents/agent-q.meta.json").write_text('{"agentType": "helper"}')
    (d / "empty.jsonl").write_text("")
    files = transcripts.read_files(spark, str(d))
    lines = transcripts.parsed_lines(transcripts.transcript_lines(files)).cache()
    return transcripts.list_files(spark, str(d)), lines, transcripts.events(lines).cache()


def test_kinds_and_line_numbers(parsed):
    got = [(r.idx, r.seq, r.kind) for r in parsed[2].where("session_id = 's1'").orderBy("idx", "seq").collect()]
    assert got == [
        (0, 0, "user_msg"), (1, 0, "assistant_msg"), (1, 1, "tool_use"), (1, 2, "tool_use"), (2, 0, "tool_result"), (2, 1, "tool_result"), (6, 0, "hook"), (6, 1, "hook"),
        (7, 0, "compaction"), (8, 0, "compaction"), (9, 0, "summary"), (10, 0, "hook"), (11, 0, "system"), (12, 0, "unknown"), (13, 0, "user_msg"),
    ]


def test_fields(parsed):
    e = {(r.idx, r.seq): r for r in parsed[2].where("session_id = 's1'").collect()}
    assert e[1, 0].text == "a\nb" and e[1, 0].usage.input == 5 and e[1, 0].usage.output == 0
    assert json.loads(e[1, 1].tool_input) == {"file_path": "/r/x"} and e[2, 1].is_error and e[10, 0].hook_event == "PreToolUse"


def test_subagents_merge_by_time_main_first(parsed):
    got = [(r.idx, r.agent) for r in parsed[2].where("session_id = 's2' AND seq = 0").orderBy("idx").collect()]
    assert got == [(0, None), (1, "helper"), (2, None), (3, "helper")]


def test_health_units_results(parsed):
    files, lines, e = parsed
    h = {r.session_id: r for r in transcripts.session_health(lines, e).collect()}
    assert (h["s1"].bad_lines, h["s1"].unknown_types, h["s1"].parse_status, h["s1"].version) == (2, {"weird": 1}, "degraded", "2.1.3")
    assert h["s2"].parse_status == "ok"
    assert {r.session_id: r.files for r in transcripts.session_units(files).collect()} == {"s1": 1, "s2": 2}
    assert {(r.tool_use_id, r.result_text) for r in transcripts.first_results(e).where("session_id = 's1'").collect()} == {("t1", "out"), ("t2", "err")}


def test_stats(parsed):
    s = attribution.session_stats(parsed[2]).where("session_id = 's1'").first()
    assert (s.turns, s.compactions, s.prompt_digest, s.summary) == (1, 2, "hello", "S")


def call(spark, rows):
    """Events of calls (idx, tool, input, result) in one window, an answer before each."""
    out = []
    for idx, tool, given, result in rows:
        out.append(("s", 3 * idx, 0, "assistant_msg", None, None, None, None, False))
        out.append(("s", 3 * idx, 1, "tool_use", None, tool, json.dumps(given), f"t{idx}", None))
        out.append(("s", 3 * idx + 1, 0, "tool_result", result, None, None, f"t{idx}", False))
    df = spark.createDataFrame(out, "session_id string, idx long, seq int, kind string, text string, tool_name string, tool_input string, tool_use_id string, is_error boolean")
    return df.selectExpr("*", "false AS is_sidechain", "cast(null AS string) AS agent", "'/r' AS cwd")


def test_facts(spark):
    e = call(spark, [
        (0, "Grep", {"pattern": "fooBar|def "}, "/r/a.py hit"), (1, "Read", {"file_path": "/r/a.py"}, "text of a"), (2, "Bash", {"command": "rg 'order_total' src"}, "x" * 40),
        (3, "Bash", {"command": "ls a"}, "aaaa"), (4, "Bash", {"command": "ls b"}, "bbbb"), (5, "Edit", {"file_path": "/r/a.py"}, "ok"),
    ])
    got = {(r.kind, r.key): (r.idx, r.tokens_est, r.confidence, r.occupancy_est) for r in facts.extract(e, transcripts.first_results(e)).collect()}
    assert got[("search", "foobar")] == (0, 1, "exact", 5) and got[("mapping", "code structure")][0] == 0
    assert got[("chain_read", "foobar")] == (3, 3, "heuristic", 12)
    assert got[("search", "ordertotal")] == (6, 10, "exact", 30)
    assert got[("mapping", "repo layout")] == (9, 2, "heuristic", 4)


def test_stale_cases(spark):
    rows = [("s", "m", i, 0, op, p, 5, False, exact, "T") for i, (op, p, exact) in enumerate([("read", "a", True), ("mutate", "a", True), ("mutate", "a", True), ("read", "a", True), ("read", "b", True), ("mutate", None, True), ("compact", None, True), ("mutate", "b", True)])]
    ops = spark.createDataFrame(rows, "session_id string, w string, idx long, seq int, op string, path string, tokens long, partial boolean, exact boolean, tool string")
    got = {(r.path, r.read_idx, r.mutate_idx, r.close_idx, r.outcome, r.confidence) for r in windows.stale_windows(ops, ["w"]).collect()}
    assert got == {("a", 0, 1, 3, "re-read", "exact"), ("a", 3, 5, 6, "compacted", "heuristic"), ("b", 4, 5, 6, "compacted", "heuristic")}


def test_appended_ingests_replace_sessions(spark, tmp_path):
    """The latest committed ingest of a session counts; one written twice changes nothing, and one without its list of sessions is never seen."""
    path = str(tmp_path / "t")
    a = spark.createDataFrame([("s1", 1), ("s1", 2), ("s2", 3)], "session_id string, v long")
    assert archive.next_ingest(spark, path) == 0
    for _ in range(2):
        archive.append(path, 0, a, {"rows": a})
    now = lambda: sorted(map(tuple, archive.current(spark, path, "rows").collect()))
    assert archive.snapshot(archive.current(spark, path, "rows"))[0] == 3 and archive.next_ingest(spark, path) == 1
    b = spark.createDataFrame([("s1", 9)], "session_id string, v long")
    archive.append(path, 1, b, {"rows": b})
    assert now() == [("s1", 9), ("s2", 3)]
    b.withColumn("v", b.v + 1).write.parquet(f"{path}/rows/ingest=2")
    assert now() == [("s1", 9), ("s2", 3)]
    archive.append(path, 2, b, {"rows": b.where("false")})
    assert now() == [("s2", 3)]
    archive.compact(spark, path, ["rows"], str(tmp_path / "u"))
    assert [tuple(r) for r in archive.current(spark, str(tmp_path / "u"), "rows").collect()] == [("s2", 3)]


def test_subagents_of_one_name_keep_their_own_order(spark, tmp_path):
    """Two scouts, each with a time on its first line only: their lines stay together, file by file."""
    d = tmp_path / "s/subagents"
    d.mkdir(parents=True)
    line = lambda name, at=None: json.dumps({"type": "user", "message": {"content": name}} | ({"timestamp": f"2026-01-01T0{at}:00:00Z"} if at else {}))
    (tmp_path / "s.jsonl").write_text(line("main", 1))
    for agent, at in (("a", 1), ("b", 2)):
        (d / f"agent-{agent}.jsonl").write_text("\n".join([line(f"{agent}0", at), line(f"{agent}1"), line(f"{agent}2")]))
        (d / f"agent-{agent}.meta.json").write_text('{"agentType": "scout"}')
    events = transcripts.events(transcripts.parsed_lines(transcripts.transcript_lines(transcripts.read_files(spark, str(tmp_path)))))
    got = events.orderBy("idx").collect()
    assert [r.text for r in got] == ["main", "a0", "a1", "a2", "b0", "b1", "b2"] and [r.agent for r in got] == [None] + ["scout"] * 6 and [r.idx for r in got] == list(range(7))


def test_an_archive_reads_only_parts_with_current_rows(spark, tmp_path):
    """Replaced parts are not opened, a few sessions open their own buckets, and compaction in place leaves one ingest of the older ones."""
    path = str(tmp_path / "t")
    rows = lambda v: spark.createDataFrame([(f"s{k}", v) for k in range(40)], "session_id string, v long")
    for n in range(3):
        archive.append(path, n, rows(n), {"rows": rows(n), "none": rows(n).where("false")})
    one = spark.createDataFrame([("s7", 9)], "session_id string, v long")
    archive.append(path, 3, one, {"rows": one, "none": one.where("false")})
    files = lambda df: {"/".join(f.split("/")[-3:-1]) for f in df.inputFiles()}
    every, few = archive.current(spark, path, "rows"), archive.current(spark, path, "rows", one)
    assert {r.session_id: r.v for r in every.collect()} == {f"s{k}": 9 if k == 7 else 2 for k in range(40)}
    scanned = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in scanned(every) and [tuple(r) for r in few.collect()] == [("s7", 9)] and archive.current(spark, path, "none").count() == 0
    assert len(archive.latest(spark, path).where("ingest < 2").collect()) == 0 and files(every)
    archive.compact(spark, path, ["rows", "none"], keep=1)
    assert archive.committed(spark, path) == [3, 4]
    assert {r.session_id: r.v for r in archive.current(spark, path, "rows").collect()} == {f"s{k}": 9 if k == 7 else 2 for k in range(40)}


def test_what_a_crash_left_of_the_first_commit_hinders_nothing(spark, tmp_path):
    path = tmp_path / "t"
    (path / "ingests/ingest=0/_temporary/0").mkdir(parents=True)
    assert archive.next_ingest(spark, str(path)) == 0 and archive.committed(spark, str(path)) == []
    a = spark.createDataFrame([("s1", 1)], "session_id string, v long")
    archive.append(str(path), 0, a, {"rows": a})
    assert archive.current(spark, str(path), "rows").count() == 1


def test_a_batch_tried_again_has_its_number(spark, tmp_path):
    path = str(tmp_path / "t")
    assert [archive.reserve(spark, path, o) for o in ("live-0", "live-0", "live-1")] == [0, 0, 1] and archive.next_ingest(spark, path) == 2


def test_commands_are_taken_apart_once(spark, tmp_path):
    path = str(tmp_path / "t")
    of = lambda *c: spark.createDataFrame([(x,) for x in c], "command string")
    first = archive.known_commands(spark, path, 0, of("cat a; ls b", "", "cat a; ls b"))
    assert sorted((r.command, r.seg_no, r.head) for r in first.collect()) == [("cat a; ls b", 0, "cat"), ("cat a; ls b", 1, "ls")]
    ids = spark.createDataFrame([("s",)], "session_id string")
    archive.append(path, 0, ids, {})
    again = archive.known_commands(spark, path, 1, of("cat a; ls b", "", "rm c"))
    assert sorted((r.command, r.head) for r in again.collect()) == [("cat a; ls b", "cat"), ("cat a; ls b", "ls"), ("rm c", "rm")]
    assert [r.command for r in spark.read.parquet(f"{path}/commands/ingest=1").collect()] == ["rm c"]


def test_lines_of_split_files(spark, tmp_path):
    """Files cut into splits of a few bytes give the numbers that whole files give."""
    (tmp_path / "s1").mkdir()
    rows = {"s1.jsonl": "\n".join(f'{{"n": {k}}}' + " " * (k % 7) if k % 5 else "" for k in range(200)), "s2.jsonl": '{"a": 1}\r\n\r\n{"b": 2}\n', "s1/s3.jsonl": "x" * 300 + "\nlast"}
    for name, text in rows.items():
        (tmp_path / name).write_text(text, newline="")
    (tmp_path / "other.txt").write_text("no\n")
    want = sorted(map(tuple, transcripts.transcript_lines(transcripts.read_files(spark, str(tmp_path))).collect()), key=str)
    bytes_ = "spark.sql.files.maxPartitionBytes"
    spark.conf.set(bytes_, "64b")
    try:
        got = transcripts.labelled_lines(transcripts.read_lines(spark, str(tmp_path)), transcripts.read_labels(spark, str(tmp_path)))
        assert sorted(map(tuple, got.collect()), key=str) == want and len(want) > 160
    finally:
        spark.conf.unset(bytes_)
