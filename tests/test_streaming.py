"""Streams give what the batch form gives."""

import time

from loomline.operators import facts, windows
from loomline.plans.session_queries import _ops, session_events
from loomline.streaming import live
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F


@pytest.fixture(autouse=True)
def provider(spark):
    """State by key needs the provider that keeps it so."""
    spark.conf.set(*live.PROVIDER)
    yield
    spark.conf.unset(live.PROVIDER[0])


def settle(q, rows, seconds=60):
    """Wait until the query has taken in so many rows; where timeouts are on, batches without rows never end, so there is no waiting for the last."""
    taken, end = {}, time.time() + seconds
    while sum(taken.values()) < rows:
        assert q.isActive and time.time() < end, q.exception()
        taken |= {p["batchId"]: p["numInputRows"] for p in q.recentProgress}
        time.sleep(0.05)


def through(spark, df, tmp_path, build, mode="append", parts=3, drain=False):
    """df as a stream of ``parts`` batches, each session cut at positions of its own; ``drain`` waits for the batches without rows that a watermark brings."""
    src = str(tmp_path / "in")
    share = F.percent_rank().over(Window.partitionBy("session_id").orderBy("idx", "seq") if "seq" in df.columns else Window.partitionBy("session_id").orderBy("idx"))
    cut = df.withColumn("part", F.least(F.lit(parts - 1), F.floor(share * parts))).cache()
    name = f"q{abs(hash(src)) % 10**9}"
    stream, q = None, None
    for k in range(parts):
        cut.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(src)
        if q is None:
            stream = spark.readStream.schema(df.schema).parquet(src)
            q = build(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).start()
        settle(q, cut.where(F.col("part") <= k).count())
    if drain:
        q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_occupancy(spark, sf_dir, tmp_path):
    e = session_events(spark, sf_dir).where("event_type = 'click'").select("session_id", "idx", "tokens")
    got = through(spark, e, tmp_path, live.live_occupancy, "complete")
    assert sorted(got.select("session_id", "current", "peak").collect()) == sorted(windows.latest_and_peak(e).collect())


def test_stale(spark, sf_dir, tmp_path):
    ops = _ops(spark, sf_dir).select("session_id", "w", "idx", "seq", "op", "path", "tokens", "partial", "exact", "tool")
    want = windows.stale_windows(ops, ["w"]).where("outcome <> 'never-re-read'")
    want = {(str(r.session_id), str(r.w), r.path, r.read_idx, r.mutate_idx, r.close_idx, r.outcome) for r in want.collect()}
    got = through(spark, ops, tmp_path, lambda s: live.live_stale(s, as_of_end=False))
    assert {(r.session_id, r.w, r.path, r.read_idx, r.mutate_idx, r.close_idx, r.outcome) for r in got.collect()} == want


def test_chain_reads(spark, sf_dir, tmp_path):
    e = session_events(spark, sf_dir).where("event_type IN ('click', 'view')")
    k = F.col("k")
    stream = e.select("session_id", (k % 2).alias("w"), "idx", "seq", F.when(F.col("event_type") == "click", "search").otherwise("read").alias("op"), F.format_string("key%d", k % 5).alias("key"), F.format_string("f%d.py", k % 4).alias("path"), F.lit("/r").alias("cwd"), F.format_string("f%d.py f%d.py", k % 4, (k + 1) % 4).alias("text"), "tokens")
    want = {(str(r.session_id), r.idx, r.key, r.raw) for r in facts.chain_reads(stream, ["w"]).collect()}
    got = through(spark, stream, tmp_path, live.live_chain_reads)
    assert want and {(r.session_id, r.idx, r.key, r.path) for r in got.collect()} == want


def test_sessions_and_counters(spark, sf_dir, tmp_path):
    e = session_events(spark, sf_dir).select("session_id", "idx", "ts", F.lit("user_msg").alias("kind"), "tokens")
    got = through(spark, e, tmp_path, lambda s: live.live_counters(s, "100 days"), "update", 1)
    assert got.agg(F.sum("turns")).first()[0] == e.count()


def test_late_rows_are_told(spark, tmp_path):
    """A row behind the last position is late; one of the same line but a later seq is not."""
    def feed(rows, kind):
        src = str(tmp_path / kind)
        schema = "session_id string, w string, idx long, seq int, op string, key string, path string, text string, cwd string, tokens long"
        q, n = None, 0
        for batch in rows:
            n += len(batch)
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
            if q is None:
                stream = spark.readStream.schema(schema).parquet(src)
                out = live.live_stale(stream, as_of_end=False) if kind == "stale" else live.live_chain_reads(stream)
                q = out.writeStream.format("memory").queryName(kind).outputMode("append").option("checkpointLocation", str(tmp_path / f"cp-{kind}")).start()
            settle(q, n)
        q.stop()
        return spark.table(kind).collect()

    row = lambda idx, seq, op, path, key=None, text=None: ("s", "m", idx, seq, op, key, path, text, "/r/", 5)
    got = feed([[row(1, 0, "read", "a"), row(4, 0, "read", "b")], [row(4, 1, "mutate", "a"), row(2, 0, "mutate", "b")], [row(6, 0, "read", "a")]], "stale")
    assert sorted((r.path, r.outcome, r.read_idx, r.mutate_idx, r.close_idx) for r in got) == [("a", "re-read", 1, 4, 6), ("b", "late", 2, None, None)]
    got = feed([[row(1, 0, "search", None, "k", "x.py")], [row(2, 0, "read", "/r/x.py"), row(3, 0, "read", "/q/x")], [row(1, 0, "read", "/r/x.py"), row(4, 0, "search", None, "j", "")]], "chain")
    assert sorted((r.idx, r.key, r.path, r.late) for r in got) == [(1, None, "/r/x.py", True), (2, "k", "/r/x.py", False)]


def test_idle_sessions_end(spark, tmp_path):
    """A session idle beyond its time emits what was never read again, and later rows find no state of it."""
    src, schema = str(tmp_path / "in"), "session_id string, w string, idx long, seq int, op string, path string, tokens long"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    put([("s", "m", 1, 0, "read", "a", 5), ("s", "m", 2, 0, "mutate", "a", None)])
    q = live.live_stale(spark.readStream.schema(schema).parquet(src), idle_ms=1500).writeStream.format("memory").queryName("idle").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    settle(q, 2)
    time.sleep(4)
    put([("s", "m", 1, 0, "read", "a", 5)])  # not late any more
    settle(q, 3)
    q.stop()
    got = [(r.session_id, r.outcome, r.close_idx) for r in spark.table("idle").collect()]
    assert got == [("s", "never-re-read", None)]


def test_activity_sessions(spark, sf_dir, tmp_path):
    """Stretches of activity equal those found by gaps in the batch."""
    e = session_events(spark, sf_dir).select("session_id", "idx", "ts")
    far = spark.createDataFrame([(10**6, 0, None)], "session_id long, idx long, ts timestamp").withColumn("ts", F.lit("2100-01-01").cast("timestamp"))
    got = through(spark, e.unionByName(far), tmp_path, lambda s: live.activity_sessions(s, "6 hours", "1000 days"), parts=1, drain=True)
    order = Window.partitionBy("session_id").orderBy("ts", "idx")
    gap = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(order)) >= 6 * 3600
    want = e.withColumn("new", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("stretch", F.sum("new").over(order))
    want = want.groupBy("session_id", "stretch").agg(F.min("ts").alias("started_at"), F.count("*").alias("events")).drop("stretch")
    assert sorted(map(tuple, got.where("session_id < 1000000").select("session_id", "started_at", "events").collect())) == sorted(map(tuple, want.collect()))


def test_archive_writer(spark, tmp_path):
    """A session's batches add up; a repeated batch changes nothing, and a later one corrects rows of its keys."""
    path = str(tmp_path / "arch")
    rows = lambda *r: spark.createDataFrame(r, "session_id string, idx long, seq int, v long")
    write = live.archive_writer(path)
    write(rows(("a", 0, 0, 1), ("b", 0, 0, 2)), 0)
    write(rows(("a", 1, 0, 3)), 1)
    write(rows(("a", 1, 0, 3)), 1)
    write(rows(("b", 0, 0, 9)), 2)
    assert sorted(map(tuple, live.archived(spark, path).collect())) == [("a", 0, 0, 1), ("a", 1, 0, 3), ("b", 0, 0, 9)]
