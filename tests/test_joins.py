"""Tables that grow with the sessions are never sent whole to the driver, however small their files look."""

import pytest
from pyspark.sql import functions as F

from loomline.operators import attribution, facts, joins, reports, stale, timeline, windows
from loomline.operators.guidance import written
from loomline.plans import lifecycle_queries as q
from loomline.sources import transcripts


def broadcasts(df) -> int:
    """Broadcast joins of a plan."""
    return df._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin")


@pytest.fixture(scope="module")
def played(spark, sf_dir):
    events = written(q._changed(spark, sf_dir), "events")
    return events, written(transcripts.first_results(events), "results"), written(q._owned(spark, sf_dir), "owned")


def test_calls_meet_results_and_sessions_without_broadcast(played):
    assert broadcasts(timeline.calls_with_results(*played)) == 0


def test_first_events_meet_sessions_without_broadcast(played):
    assert broadcasts(attribution.first_events(played[0], played[2])) == 0


def test_stale_copies_broadcast_only_commands(played, spark):
    ops = written(stale.stale_ops(*played, q.said(played[0])), "ops")
    assert broadcasts(windows.stale_windows(ops)) == 0


def test_facts_broadcast_only_commands(played):
    # The digest of commands meets the calls of each of the four parts; sessions and results are not among what is broadcast.
    assert broadcasts(facts.extract(*played, q.said(played[0]))) == 4


def test_usages_and_loads_without_broadcast(played, spark):
    marks = written(spark.createDataFrame([(1, "c", "loaded", 0, 0, "exact", "s")], "session_id long, component_id string, state string, idx long, seq int, confidence string, summary string"), "marks")
    assert broadcasts(attribution.usages(marks)) == 0
    reads = written(spark.createDataFrame([(1, "p", "Read", 0, 0, "exact", None)], "session_id long, path string, tool string, idx long, seq int, confidence string, range struct<first: long, last: long>"), "loads")
    assert broadcasts(reports.file_loads(reads)) == 0


def marks_of(spark):
    return written(spark.createDataFrame([(1, "c", "loaded", 0, 0, "exact", "s")] * 40, "session_id long, component_id string, state string, idx long, seq int, confidence string, summary string"), "marks")


def test_tasks_grow_with_the_rows_of_sessions(played, spark, monkeypatch):
    # Left alone, Spark puts partitions together until there is about one a core, and a task sorts rows that grow with the input.
    monkeypatch.setattr(joins, "ROWS", 5)
    events, _, owned = played
    for df in (transcripts.first_results(events), timeline.calls_with_results(*played), attribution.first_events(events, owned), attribution.usages(marks_of(spark))):
        exchanges = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
        assert exchanges and all("REPARTITION_BY_NUM" in x for x in exchanges)
    assert joins.tasks_for(events) == -(-events.count() // 5)


def test_calls_of_a_name_are_not_brought_into_one_task(played, spark):
    calls = played[0].where("tool_name = 'Read'").select(q.F.lit("r0").alias("repo_id"), q.F.lit("fmt").alias("name"), "session_id")
    found = attribution.resolved(calls, q.components(spark), "skill")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    assert found.count() == calls.count()


def test_usages_keep_the_first_marks_and_count_all(spark):
    got = attribution.usages(marks_of(spark), shown=3).first()
    assert (got["count"], len(got["evidence"]), got["confidence"]) == (40, 3, "exact")


def test_misses_and_states_deal_rows_by_their_number(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(joins, "ROWS", 5)
    uses = attribution.usages(marks_of(spark))
    sessions = q._owned(spark, sf_dir).withColumns({"commits": q.F.lit(1), "version": q.F.lit("2.1.7")})
    for df in (attribution.session_misses(sessions, uses, q.components(spark)), reports.session_components(sessions, uses, q.components(spark))):
        exchanges = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
        assert exchanges and all("REPARTITION_BY_NUM" in x for x in exchanges)


def test_calls_of_one_name_are_cut_into_shares(spark, monkeypatch):
    """Pairs of one name and its candidates are made in many tasks, and are the same ones."""
    calls = spark.range(4000).select(F.col("id").alias("session_id"), F.format_string("r%d", F.col("id") % 1).alias("repo_id"), F.lit(0).alias("idx"), F.lit(0).alias("seq"), F.when(F.col("id") % 4 == 0, "none").when(F.col("id") % 400 == 1, "p:one").otherwise("s").alias("name"))
    own = spark.range(31).select(F.format_string("r%d", F.col("id") % 1).alias("repo_id"), F.col("id").cast("string").alias("id"), F.lit("skill").alias("type"), F.when(F.col("id") == 0, "one").otherwise("s").alias("name"), F.lit("plugin:p").alias("source"))
    alike = lambda rows: sorted(map(tuple, rows.select("session_id", "component_id", "sure").collect()))
    want = alike(attribution.resolved(calls, own, "skill"))
    assert len(want) == 10 + 2990 * 30
    monkeypatch.setattr(attribution, "PAIRS", 1000, raising=False)
    for few in (0, 100_000):
        monkeypatch.setattr(attribution, "FEW", few)
        got = attribution.resolved(calls, own, "skill")
        assert alike(got) == want
        most = got.groupBy(F.spark_partition_id().alias("task")).count().agg(F.max("count")).first()[0]
        assert most < len(want) / 8, (few, most)


def test_pairs_of_a_name_with_many_candidates_take_little_room(spark, monkeypatch, tmp_path):
    """The calls of a share repeat for each candidate; candidates repeated for each call took some four bytes a pair."""
    monkeypatch.setattr(attribution, "FEW", 0)
    calls = spark.range(150).select((F.col("id") * 7919 % 100_003).alias("session_id"), F.lit("r0").alias("repo_id"), F.lit(0).alias("idx"), F.lit(0).alias("seq"), F.lit("s").alias("name"))
    own = spark.range(20_000).select(F.lit("r0").alias("repo_id"), (F.col("id") * 400).cast("string").alias("id"), F.lit("skill").alias("type"), F.lit("s").alias("name"), F.lit(None).cast("string").alias("source"))
    attribution.resolved(calls, own, "skill").select("session_id", "component_id", "sure").write.option("compression", "snappy").parquet(str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "pairs")).distinct().count() == 150 * 20_000
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 150 * 20_000


def test_names_with_more_candidates_than_a_share_has_calls(spark, monkeypatch):
    calls = spark.range(3000).select(F.col("id").alias("session_id"), F.format_string("r%d", F.col("id") % 2).alias("repo_id"), F.lit(0).alias("idx"), F.lit(0).alias("seq"), F.when(F.col("id") % 5 == 0, "p:s").when(F.col("id") % 7 == 0, "none").otherwise("s").alias("name"))
    own = spark.range(60).select(F.format_string("r%d", F.col("id") % 2).alias("repo_id"), F.col("id").cast("string").alias("id"), F.lit("skill").alias("type"), F.lit("s").alias("name"), F.when(F.col("id") % 3 == 0, "plugin:p").alias("source"))
    alike = lambda: sorted(map(tuple, attribution.resolved(calls, own, "skill").select("session_id", "component_id", "sure", "name", "repo_id").collect()))
    want = alike()
    assert len(want) == 600 * 10 + 2057 * 30
    monkeypatch.setattr(attribution, "FEW", 0)
    for most, copies in ((10, 2_000_000), (10, 100), (29, 1000), (30, 1000)):
        monkeypatch.setattr(attribution, "CALLS", most, raising=False)
        monkeypatch.setattr(attribution, "COPIES", copies, raising=False)
        assert alike() == want
