"""Queries over session events, on the events table: users are sessions, event types are kinds of event."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.operators import attribution, costs, facts, reports, windows

from .registry import query, table

E = """WITH e AS (
  SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, event_id, event_type, ts, CAST(ceil(value) AS BIGINT) AS tokens,
    CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events
)"""


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return rows.select(F.col("user_id").alias("session_id"), (F.row_number().over(order) - 1).cast("long").alias("idx"), F.lit(0).alias("seq"), "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.ceil("value").cast("long").alias("tokens"), k.alias("k"))


def _kinds(e: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "assistant_msg").when((F.col("event_type") == "error") & (F.col("k") % 4 == 0), "compaction").otherwise("other")
    return e.withColumn("kind", kind).withColumn("w", F.col("k") % 2)


@query(E + """, f AS (SELECT * FROM e WHERE event_type = 'signup'), m AS (SELECT session_id, k % 2 AS w, idx FROM e WHERE event_type = 'click'),
c AS (SELECT session_id, k % 2 AS w, idx FROM e WHERE event_type = 'error' AND k % 4 = 0),
b AS (SELECT f.event_id, min(c.idx) AS bound FROM f LEFT JOIN c ON c.session_id = f.session_id AND c.w = f.k % 2 AND c.idx > f.idx GROUP BY f.event_id),
n AS (SELECT f.event_id, count(CASE WHEN m.idx > f.idx AND (b.bound IS NULL OR m.idx < b.bound) THEN 1 END) AS remaining, count(m.idx) AS turns
  FROM f JOIN b ON b.event_id = f.event_id LEFT JOIN m ON m.session_id = f.session_id AND m.w = f.k % 2 GROUP BY f.event_id)
SELECT f.event_id, f.session_id, f.idx, CASE WHEN n.turns > 0 THEN f.tokens * n.remaining END AS occupancy_est FROM f JOIN n ON n.event_id = f.event_id""")
def occupancy_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _kinds(session_events(spark, sf_dir))
    found = e.where("event_type = 'signup'").select("event_id", "session_id", "idx", "w", F.col("tokens").alias("tokens_est"))
    return windows.occupancy(found, e, ["w"]).select("event_id", "session_id", "idx", "occupancy_est")


def _ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = session_events(spark, sf_dir)
    k, kind = F.col("k"), F.col("event_type")
    op = F.when(kind == "view", "read").when(kind == "purchase", "mutate").when(kind == "error", F.when(k % 4 == 0, "compact").otherwise("mutate"))
    path = F.when(kind.isin("view", "purchase"), F.concat(F.lit("p"), (k % 3).cast("string")))
    return e.select("session_id", "idx", "seq", (k % 2).alias("w"), op.alias("op"), path.alias("path"), "tokens", F.lit(False).alias("partial"), F.lit(True).alias("exact"), kind.alias("tool")).where("op IS NOT NULL")


STALE = E + """, r AS (SELECT session_id, k % 2 AS w, 'p' || (k % 3) AS path, idx, tokens FROM e WHERE event_type = 'view'),
key AS (SELECT DISTINCT session_id, w, path FROM r),
s AS (
  SELECT session_id, w, path, idx, 'R' AS op, tokens, false AS same FROM r
  UNION ALL SELECT key.session_id, key.w, key.path, e.idx, 'M', NULL, e.event_type = 'purchase' AND e.k % 2 = key.w FROM key JOIN e ON e.session_id = key.session_id
    AND ((e.event_type = 'purchase' AND 'p' || (e.k % 3) = key.path) OR (e.event_type = 'error' AND e.k % 4 <> 0))
  UNION ALL SELECT key.session_id, key.w, key.path, e.idx, 'C', NULL, false FROM key JOIN e ON e.session_id = key.session_id AND e.event_type = 'error' AND e.k % 4 = 0 AND e.k % 2 = key.w
), n AS (
  SELECT *, lead(op) OVER o AS next_op, lead(idx) OVER o AS next_idx, lead(same) OVER o AS next_same,
    min(CASE WHEN op IN ('R', 'C') THEN idx END) OVER (PARTITION BY session_id, w, path ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS close_idx
  FROM s WINDOW o AS (PARTITION BY session_id, w, path ORDER BY idx)
), stale AS (
  SELECT n.session_id, n.w, n.path, n.idx AS read_idx, n.next_idx AS mutate_idx, n.close_idx, CASE WHEN n.close_idx IS NULL THEN 'never-re-read' WHEN c.op = 'R' THEN 're-read' ELSE 'compacted' END AS outcome,
    n.tokens AS read_tokens_est, CASE WHEN n.next_same THEN 'exact' ELSE 'heuristic' END AS confidence
  FROM n LEFT JOIN s c ON c.session_id = n.session_id AND c.w = n.w AND c.path = n.path AND c.idx = n.close_idx WHERE n.op = 'R' AND n.next_op = 'M'
)"""


@query(STALE + " SELECT * FROM stale")
def stale_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.stale_windows(_ops(spark, sf_dir), ["w"]).select("session_id", "w", "path", "read_idx", "mutate_idx", "close_idx", "outcome", "read_tokens_est", "confidence")


@query(STALE + """ SELECT session_id, count(*) AS windows, count(CASE WHEN outcome = 'never-re-read' THEN 1 END) AS never_re_read,
  CAST(coalesce(sum(CASE WHEN outcome = 'never-re-read' THEN read_tokens_est END), 0) AS BIGINT) AS never_re_read_tokens FROM stale GROUP BY session_id""")
def stale_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.stale_summary(windows.stale_windows(_ops(spark, sf_dir), ["w"]))


@query(STALE + """ SELECT stale.session_id, mutate_idx, e.event_type AS mutate_tool, outcome, CAST(count(*) AS INTEGER) AS files, array_to_string(list_sort(list(path))[1:3], ', ') AS first_paths,
  CAST(greatest(count(*) - 3, 0) AS INTEGER) AS more FROM stale JOIN e ON e.session_id = stale.session_id AND e.idx = mutate_idx GROUP BY ALL""")
def stale_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.stale_folded(windows.stale_windows(_ops(spark, sf_dir), ["w"]))


@query(E + """, m AS (SELECT session_id, idx, CASE WHEN event_type = 'click' THEN 1 WHEN event_type = 'error' AND k % 4 = 0 THEN 0 END AS rank, tokens, event_type, event_id FROM e),
g AS (SELECT *, count(CASE WHEN rank = 0 THEN 1 END) OVER (PARTITION BY session_id ORDER BY idx) AS stretch FROM m),
o AS (SELECT *, last_value(CASE WHEN rank = 1 THEN tokens END IGNORE NULLS) OVER (PARTITION BY session_id, stretch ORDER BY idx) AS occupancy FROM g)
SELECT session_id, idx, event_id, occupancy FROM o WHERE event_type = 'view'""")
def measured_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _kinds(session_events(spark, sf_dir))
    rows = e.where("event_type = 'view'").select("session_id", "idx", "event_id", F.lit(False).alias("is_sidechain"))
    return windows.measured(rows, e.where("kind = 'assistant_msg'"), e.where("kind = 'compaction'")).select("session_id", "idx", "event_id", "occupancy")


@query(E + " SELECT session_id, arg_max(tokens, idx) AS current, max(tokens) AS peak FROM e WHERE event_type = 'click' GROUP BY session_id")
def latest_and_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.latest_and_peak(session_events(spark, sf_dir).where("event_type = 'click'"))


@query(E + """, b AS (SELECT *, count(CASE WHEN event_type IN ('view', 'purchase') THEN 1 END) OVER (PARTITION BY session_id, k % 2 ORDER BY idx) AS island, k % 2 AS w FROM e)
SELECT session_id, w, min(idx) AS idx, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM b WHERE event_type = 'signup' GROUP BY session_id, w, island HAVING count(*) >= 2""")
def listing_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = session_events(spark, sf_dir).withColumn("w", F.col("k") % 2)
    return windows.runs(e, "event_type = 'signup'", "event_type IN ('view', 'purchase')", ["w"])


@query("""WITH b AS (SELECT user_id AS session_id, ts, max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events)
SELECT session_id, coalesce(bool_or(before - ts > INTERVAL 300 SECOND), false) AS out_of_order FROM b GROUP BY session_id""")
def out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.turns_backwards(table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("idx"), "ts"))


@query(E + """, s AS (SELECT session_id, k % 2 AS w, idx, event_type, 'key' || (k % 5) AS key, 'src/f' || (k % 4) || '.py' AS path, 'hits: src/f' || (k % 4) || '.py src/f' || ((k + 1) % 4) || '.py' AS text, tokens
  FROM e WHERE event_type IN ('click', 'view')),
n AS (SELECT *, max(CASE WHEN event_type = 'click' THEN idx END) OVER (PARTITION BY session_id, w ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last,
  min(CASE WHEN event_type = 'click' THEN idx END) OVER (PARTITION BY session_id, w ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM s)
SELECT n.session_id, n.w, n.idx, p.key, n.path AS raw, n.tokens AS tokens_est FROM n JOIN s p ON p.session_id = n.session_id AND p.idx = n.last
WHERE n.event_type = 'view' AND n.next IS NOT NULL AND contains(p.text, n.path)""")
def chain_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = session_events(spark, sf_dir).where("event_type IN ('click', 'view')").withColumn("w", F.col("k") % 2)
    file = lambda k: F.format_string("src/f%d.py", k % 4)
    op = F.when(F.col("event_type") == "click", "search").otherwise("read")
    stream = e.select("session_id", "w", "idx", "seq", op.alias("op"), F.format_string("key%d", F.col("k") % 5).alias("key"), file(F.col("k")).alias("path"), F.lit("/repo").alias("cwd"), F.concat(F.lit("hits: "), file(F.col("k")), F.lit(" "), file(F.col("k") + 1)).alias("text"), "tokens")
    return facts.chain_reads(stream, ["w"]).select("session_id", "w", "idx", "key", "raw", "tokens_est")


@query(E + """, u AS (SELECT session_id, idx, event_type, 0 AS s FROM e WHERE event_type IN ('view', 'purchase') UNION ALL SELECT session_id, idx, 'again', 1 FROM e WHERE event_type = 'purchase')
SELECT session_id, idx, event_type AS detail, CAST(row_number() OVER (PARTITION BY session_id ORDER BY idx, s) AS INTEGER) AS no FROM u""")
def timeline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = session_events(spark, sf_dir)
    one = e.where("event_type IN ('view', 'purchase')").select("session_id", "idx", "seq", F.col("event_type").alias("detail"))
    two = e.where("event_type = 'purchase'").select("session_id", "idx", "seq", F.lit("again").alias("detail"))
    return windows.timeline([one, two]).select("session_id", "idx", "detail", "no")


@query(STALE + """, numbered AS (SELECT stale.*, e.event_type AS tool, row_number() OVER (PARTITION BY stale.session_id ORDER BY mutate_idx, read_idx, path) AS s FROM stale JOIN e ON e.session_id = stale.session_id AND e.idx = mutate_idx),
c AS (SELECT session_id, close_idx AS idx, string_agg(' (closes S' || s || ')', '' ORDER BY s) AS note FROM numbered WHERE outcome = 're-read' GROUP BY session_id, close_idx),
u AS (
  SELECT e.session_id, e.idx, CASE event_type WHEN 'view' THEN 'file_read' WHEN 'purchase' THEN 'action' ELSE 'other' END AS kind, event_type || CASE WHEN event_type = 'error' THEN '' ELSE coalesce(c.note, '') END AS detail, 0 AS s
  FROM e LEFT JOIN c ON c.session_id = e.session_id AND c.idx = e.idx WHERE event_type IN ('view', 'purchase', 'error')
  UNION ALL SELECT session_id, mutate_idx, 'stale_open', 'S' || s || ' ' || path || ': copy read at ' || read_idx || ', overturned by ' || tool, s FROM numbered)
SELECT session_id, idx, kind, detail, CAST(row_number() OVER (PARTITION BY session_id ORDER BY idx, s) AS INTEGER) AS no FROM u""")
def timeline_with_stale_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = session_events(spark, sf_dir).where("event_type IN ('view', 'purchase', 'error')")
    kind = F.when(F.col("event_type") == "view", "file_read").when(F.col("event_type") == "purchase", "action").otherwise("other")
    rows = windows.timeline([e.select("session_id", "idx", "seq", kind.alias("kind"), F.col("event_type").alias("detail"), F.lit("exact").alias("confidence"))])
    return windows.with_stale_rows(rows, windows.stale_windows(_ops(spark, sf_dir), ["w"])).select("session_id", "idx", "kind", "detail", "no")


@query(STALE + " SELECT session_id, w, path, read_idx, mutate_idx, CAST(row_number() OVER (PARTITION BY session_id ORDER BY mutate_idx, read_idx, path) AS INTEGER) AS stale_no FROM stale")
def stale_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.stale_numbered(windows.stale_windows(_ops(spark, sf_dir), ["w"])).select("session_id", "w", "path", "read_idx", "mutate_idx", "stale_no")


BINS = E + """, r AS (SELECT session_id, event_type AS lane, tokens AS est, idx, dense_rank() OVER (PARTITION BY session_id ORDER BY idx) - 1 AS rank FROM e),
n AS (SELECT *, max(rank) OVER (PARTITION BY session_id) + 1 AS n FROM r),
b AS (SELECT session_id, lane, CAST(least(59, rank * 59 // greatest(1, n - 1)) AS INTEGER) AS bin, CAST(sum(est) AS BIGINT) AS est, max(idx) AS last_no FROM n GROUP BY ALL)"""


@query(BINS + " SELECT *, max(est) OVER (PARTITION BY session_id) AS largest, CAST(greatest(1, round_even(sqrt(est / max(est) OVER (PARTITION BY session_id)) * 8, 0)) AS INTEGER) AS level FROM b")
def timeline_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = session_events(spark, sf_dir).select("session_id", F.col("event_type").alias("lane"), F.col("idx").alias("no"), F.col("tokens").alias("est"))
    return windows.binned(rows).withColumn("level", T.block_level("est", "largest"))


@query(E + """, r AS (SELECT session_id, event_type AS lane, tokens AS est, idx, row_number() OVER (PARTITION BY session_id ORDER BY idx) - 1 AS rank, count(*) OVER (PARTITION BY session_id) AS n FROM e),
b AS (SELECT session_id, lane, CAST(rank - greatest(0, n - 20) AS INTEGER) AS bin, est, idx AS last_no, max(est) OVER (PARTITION BY session_id) AS largest FROM r) SELECT * FROM b WHERE bin >= 0""")
def scrolled_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bin for each line; of longer sessions the last twenty, in proportion to the largest of all."""
    rows = session_events(spark, sf_dir).select("session_id", F.col("event_type").alias("lane"), F.col("idx").alias("no"), F.col("tokens").alias("est"))
    return windows.binned(rows, 20, scroll=True)


@query(BINS + " SELECT session_id, lane, max(bin) AS bin, arg_max(last_no, bin) AS last_no FROM b GROUP BY session_id, lane")
def last_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = session_events(spark, sf_dir).select("session_id", F.col("event_type").alias("lane"), F.col("idx").alias("no"), F.col("tokens").alias("est"))
    return windows.last_marks(windows.binned(rows))


@query(E + """, s AS (SELECT session_id, CAST(k % 60 AS INTEGER) AS bin, max(tokens) AS tokens FROM e WHERE event_type = 'click' GROUP BY ALL),
g AS (SELECT session_id, CAST(b AS INTEGER) AS bin FROM (SELECT DISTINCT session_id FROM s), range(60) t(b))
SELECT g.session_id, g.bin, last_value(s.tokens IGNORE NULLS) OVER (PARTITION BY g.session_id ORDER BY g.bin) AS tokens FROM g LEFT JOIN s ON s.session_id = g.session_id AND s.bin = g.bin""")
def occupancy_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = session_events(spark, sf_dir).where("event_type = 'click'").select("session_id", (F.col("k") % 60).cast("int").alias("bin"), "tokens")
    return windows.filled_bins(rows)


FACTS = E + """, f AS (SELECT session_id, idx, event_id, CASE WHEN event_type = 'view' THEN 'chain_read' ELSE 'search' END AS kind, 'key' || (k % 7) AS key, 'Raw' || (k % 3) AS raw, event_type AS tool, tokens AS tokens_est,
  CASE WHEN k % 2 = 0 THEN tokens * 2 END AS occupancy_est, CASE WHEN k % 11 = 0 THEN 'heuristic' ELSE 'exact' END AS confidence FROM e)"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return session_events(spark, sf_dir).select(
        "session_id", "idx", "event_id", F.when(F.col("event_type") == "view", "chain_read").otherwise("search").alias("kind"), F.format_string("key%d", k % 7).alias("key"), F.format_string("Raw%d", k % 3).alias("raw"),
        F.col("event_type").alias("tool"), F.col("tokens").alias("tokens_est"), F.when(k % 2 == 0, F.col("tokens") * 2).alias("occupancy_est"), F.when(k % 11 == 0, "heuristic").otherwise("exact").alias("confidence"),
    )


NEEDS = FACTS + """, b AS (SELECT key, count(DISTINCT session_id) AS sessions, count(*) AS times, CAST(sum(tokens_est) AS BIGINT) AS tokens, CAST(sum(occupancy_est) AS BIGINT) AS occupancy,
    bool_or(kind = 'chain_read') AS chain, bool_or(confidence = 'heuristic') AS heuristic FROM f GROUP BY key),
r AS (SELECT key, raw, count(*) AS n, min(event_id) AS first FROM f WHERE kind <> 'chain_read' GROUP BY key, raw),
t AS (SELECT key, count(*) AS spellings, first(raw ORDER BY n DESC, first) AS label FROM r GROUP BY key),
h AS (SELECT key, string_agg(tool, ', ' ORDER BY first) AS heads FROM (SELECT key, tool, min(event_id) AS first FROM f WHERE kind <> 'chain_read' GROUP BY key, tool) GROUP BY key),
needs AS (SELECT b.key, 'keyword' AS kind, coalesce(t.label, b.key) AS label,
  array_to_string(list_filter([h.heads, CASE WHEN t.spellings >= 2 THEN 'tried ' || t.spellings || ' spellings' END, CASE WHEN b.chain THEN 'opened hits' END], lambda x: x IS NOT NULL), ', ') || CASE WHEN b.heuristic THEN ' ~' ELSE '' END AS method,
  sessions, times, tokens, occupancy, coalesce(t.spellings, 0) AS spellings, chain, heuristic FROM b LEFT JOIN t ON t.key = b.key LEFT JOIN h ON h.key = b.key)"""


@query(NEEDS + " SELECT * FROM needs")
def information_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.needs(_facts(spark, sf_dir), ["event_id"])


@query(NEEDS + " SELECT key, tokens, times FROM needs ORDER BY tokens DESC, times DESC, key LIMIT 5")
def top_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.top_needs(facts.needs(_facts(spark, sf_dir), ["event_id"]), 5).select("key", "tokens", "times")


@query(NEEDS + " SELECT key, label, tokens, times FROM (SELECT *, row_number() OVER (ORDER BY tokens DESC, times DESC, key) AS no FROM needs) WHERE no = 2 UNION ALL SELECT key, label, tokens, times FROM needs WHERE key = 'key4' UNION ALL SELECT key, label, tokens, times FROM needs WHERE lower(label) = 'raw1'")
def picked_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One need by its rank, one by its key, and those of a label, as a user would ask for them."""
    rows = facts.needs(_facts(spark, sf_dir), ["event_id"])
    out = [facts.picked(rows, which).select("key", "label", "tokens", "times") for which in ("2", " KEY4 ", "raw1")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(FACTS + ", r AS (SELECT key, raw, count(*) AS n FROM f WHERE kind = 'search' GROUP BY key, raw), v AS (SELECT *, count(*) OVER (PARTITION BY key) AS spellings FROM r) SELECT key, raw, n, spellings FROM v WHERE spellings >= 2")
def search_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.variants(_facts(spark, sf_dir))


@query(NEEDS + " SELECT CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(tokens) * 100.0 / (SELECT sum(tokens) * 3 FROM e), 1) AS share FROM needs")
def needs_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = session_events(spark, sf_dir).agg((F.sum("tokens") * 3).alias("total"))
    return facts.output_share(facts.needs(_facts(spark, sf_dir), ["event_id"]), total)


@query(FACTS + " SELECT key, tool, raw, count(*) AS n FROM f WHERE kind <> 'chain_read' GROUP BY ALL")
def search_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.search_counts(_facts(spark, sf_dir))


@query(FACTS + " SELECT key, raw AS file, count(*) AS n FROM f WHERE kind = 'chain_read' GROUP BY ALL")
def read_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.read_counts(_facts(spark, sf_dir))


@query(FACTS + " SELECT session_id, idx, kind, tool, raw, tokens_est FROM f WHERE key = 'key3'")
def need_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.evidence(_facts(spark, sf_dir), "key3")


@query(E + """, m AS (SELECT session_id, idx // 4 AS idx, CASE WHEN k % 2 = 0 THEN 'search' ELSE 'mapping' END AS kind, 'key' || (k % 3) AS key, 'Raw' || k AS raw, event_type AS tool, tokens, event_id, CASE WHEN k % 5 = 0 THEN 'heuristic' ELSE 'exact' END AS confidence FROM e)
SELECT session_id, idx, kind, key, arg_min(raw, event_id) AS raw, arg_min(tool, event_id) AS tool, CAST(sum(tokens) AS BIGINT) AS tokens_est, max(confidence) AS confidence FROM m GROUP BY session_id, idx, kind, key""")
def merged_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    rows = session_events(spark, sf_dir).select(
        "session_id", F.lit(False).alias("is_sidechain"), F.lit(None).cast("string").alias("agent"), F.floor(F.col("idx") / 4).alias("idx"), F.col("event_id").alias("seq"), F.when(k % 2 == 0, "search").otherwise("mapping").alias("kind"),
        F.format_string("key%d", k % 3).alias("key"), F.format_string("Raw%d", k).alias("raw"), F.col("event_type").alias("tool"), F.col("tokens").alias("tokens_est"), F.when(k % 5 == 0, "heuristic").otherwise("exact").alias("confidence"),
    )
    return facts.merged(rows).drop("is_sidechain", "agent")


@query(E + """, s AS (SELECT session_id, min(ts) AS started_at, count(CASE WHEN event_type = 'error' THEN 1 END) AS commits FROM e GROUP BY session_id),
d AS (SELECT DISTINCT k % 5 AS c FROM e), asked AS (SELECT s.session_id, d.c FROM s, d WHERE s.commits > 0),
seen AS (SELECT DISTINCT session_id, k % 5 AS c FROM e WHERE event_type = 'purchase')
SELECT 'r' AS repo_id, CAST(d.c AS VARCHAR) AS component_id, count(a.c) AS missed FROM d LEFT JOIN (SELECT * FROM asked EXCEPT SELECT * FROM seen) a ON a.c = d.c GROUP BY d.c""")
def missed_hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = session_events(spark, sf_dir)
    sessions = e.groupBy("session_id").agg(F.count_if(F.col("event_type") == "error").alias("commits")).withColumn("repo_id", F.lit("r"))
    hook = (F.col("k") % 5).cast("string")
    components = e.select(hook.alias("id")).distinct().withColumn("type", F.lit("hook")).withColumn("miss_when", F.lit("git_commit")).withColumn("repo_id", F.lit("r"))
    uses = e.where("event_type = 'purchase'").groupBy("session_id", hook.alias("component_id")).agg(F.count("*").alias("count")).withColumn("state", F.lit("invoked"))
    return attribution.missed_hooks(sessions, uses, components)


# --- costs and reports on orders: orders are sessions, line items are messages or usages, parts are components ---

PRICES = [("Brand#1", 3.17031, 15.39017), ("Brand#17", 1.03013, 5.21007), ("Brand#2", 0.57019, 2.63023)]
COSTS = """WITH prices(prefix, in_usd, out_usd) AS (VALUES ('Brand#1', 3.17031::DOUBLE, 15.39017::DOUBLE), ('Brand#17', 1.03013, 5.21007), ('Brand#2', 0.57019, 2.63023)),
m AS (SELECT l_orderkey AS session_id, p_brand AS model, CAST(l_quantity * 1000 AS BIGINT) AS input, CAST(l_quantity * 10 AS BIGINT) AS output, CAST(l_linenumber * 499 AS BIGINT) AS cw, CAST(l_linenumber * 1999 AS BIGINT) AS cr FROM lineitem JOIN part ON p_partkey = l_partkey),
b AS (SELECT model, arg_max(in_usd, length(prefix)) AS i, arg_max(out_usd, length(prefix)) AS o FROM (SELECT DISTINCT model FROM m) JOIN prices ON starts_with(model, prefix) GROUP BY model),
c AS (SELECT m.*, i, ((input + cw * 1.25::DOUBLE + cr * 0.1::DOUBLE) * i + output * o) / 1e6 AS cost, input + cw + cr AS context FROM m LEFT JOIN b ON b.model = m.model),
s AS (SELECT session_id, round(sum(cost), 6) AS cost_usd, round(sum(cost * least(1.0, 5000::DOUBLE / context)), 6) AS static_usd, array_to_string(list_sort(list_distinct(list(model) FILTER (WHERE i IS NULL))), ',') AS unpriced FROM c GROUP BY session_id)"""


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = table(spark, sf_dir, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey"))
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    return rows.select(F.col("l_orderkey").alias("session_id"), F.col("p_brand").alias("model"), (q * 1000).cast("long").alias("input"), (q * 10).cast("long").alias("output"), (n * 499).cast("long").alias("cache_creation"), (n * 1999).cast("long").alias("cache_read"))


def _prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "prefix string, in_usd double, out_usd double")


@query(COSTS + " SELECT session_id, cost_usd, static_usd, coalesce(unpriced, '') AS unpriced FROM s")
def session_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return costs.session_costs(_messages(spark, sf_dir), _prices(spark), 5000).withColumn("unpriced", F.array_join("unpriced", ","))


@query("""WITH s AS (SELECT p_partkey % 3 AS r, sum(CASE WHEN p_size % 4 = 0 THEN 7 WHEN p_size % 2 = 0 THEN p_size ELSE 0 END) AS static FROM part WHERE p_size % 5 <> 0 GROUP BY 1),
""" + COSTS.removeprefix("WITH ").replace("least(1.0, 5000::DOUBLE / context)", "least(1.0, coalesce((SELECT static FROM s WHERE s.r = session_id % 3), 0)::DOUBLE / context)").replace("s AS (SELECT session_id, round", "t AS (SELECT session_id, round") + """
SELECT session_id, cost_usd, static_usd FROM t""")
def repository_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is always in context is that of the session's own repository: a skill's front matter, all of other static components, nothing of missing ones."""
    n, size = F.col("p_partkey"), F.col("p_size")
    components = table(spark, sf_dir, "part").select(
        F.format_string("r%d", n % 3).alias("repo_id"), n.cast("string").alias("id"), F.when(size % 4 == 0, "skill").otherwise("guide").alias("type"), F.when(size % 2 == 0, "static").otherwise("dynamic").alias("context"),
        size.cast("long").alias("tokens_est"), F.lit(7).cast("long").alias("tokens_meta_est"), (size % 5 == 0).alias("missing"),
    )
    owned = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.format_string("r%d", F.col("o_orderkey") % 3).alias("repo_id"))
    return costs.session_costs(_messages(spark, sf_dir), _prices(spark), costs.static_basis(components, owned)).drop("unpriced")


@query(COSTS + " SELECT m.model, b.i AS in_usd, b.o AS out_usd FROM (SELECT DISTINCT model FROM m) m LEFT JOIN b ON b.model = m.model")
def longest_prefix_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return costs.priced_models(_messages(spark, sf_dir), _prices(spark))


@query(COSTS + " SELECT round(sum(cost_usd), 4) AS cost_usd, round(sum(static_usd), 4) AS static_usd, count(CASE WHEN cost_usd IS NULL THEN 1 END) AS unpriced_sessions FROM s")
def cost_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.cost_totals(costs.session_costs(_messages(spark, sf_dir), _prices(spark), 5000))


USES = """WITH s AS (SELECT o_orderkey AS session_id, o_orderdate AS started_at FROM orders),
c AS (SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_size % 5 = 0 THEN 'hook' ELSE 'skill' END AS type, p_size % 3 <> 0 AS can_invoke, true AS can_load FROM part),
u AS (SELECT l_orderkey AS session_id, CAST(l_partkey AS VARCHAR) AS component_id, CASE l_returnflag WHEN 'R' THEN 'invoked' WHEN 'A' THEN 'loaded' ELSE 'registered' END AS state, CASE WHEN l_linestatus = 'F' THEN 'heuristic' ELSE 'exact' END AS confidence, count(*) AS count FROM lineitem GROUP BY ALL)"""
START, AS_OF = datetime(1996, 1, 1), datetime(1998, 8, 2)


def _archive(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    sessions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").alias("started_at"))
    size = F.col("p_size")
    can = F.when(size % 3 != 0, F.array(F.lit("registered"), F.lit("loaded"), F.lit("invoked"))).otherwise(F.array(F.lit("registered"), F.lit("loaded")))
    components = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.when(size % 5 == 0, "hook").otherwise("skill").alias("type"), can.alias("states"))
    state = F.when(F.col("l_returnflag") == "R", "invoked").when(F.col("l_returnflag") == "A", "loaded").otherwise("registered")
    uses = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("session_id"), F.col("l_partkey").cast("string").alias("component_id"), state.alias("state"), F.when(F.col("l_linestatus") == "F", "heuristic").otherwise("exact").alias("confidence")).agg(F.count("*").alias("count"))
    return sessions, uses, components


@query(USES + """, w AS (SELECT u.component_id, sum(CASE WHEN state = 'invoked' THEN count ELSE 0 END) AS invoked, sum(CASE WHEN state = 'loaded' THEN count ELSE 0 END) AS loaded, max(confidence) AS confidence,
    max(CASE WHEN state IN ('invoked', 'loaded') THEN started_at END) AS last_used FROM u JOIN s ON s.session_id = u.session_id WHERE started_at >= TIMESTAMP '1996-01-01' GROUP BY u.component_id),
g AS (SELECT count(*) AS n FROM orders WHERE o_orderkey % 9 = 0),
x AS (SELECT component_id, count(DISTINCT session_id) AS n FROM u WHERE state = 'invoked' AND session_id % 9 = 0 GROUP BY component_id),
r AS (SELECT c.id, c.type, c.can_invoke, CASE WHEN c.type = 'hook' THEN (SELECT n FROM g) - coalesce((SELECT x.n FROM x WHERE x.component_id = c.id), 0) ELSE 0 END AS missed, coalesce(w.invoked, 0) AS invoked, coalesce(w.loaded, 0) AS loaded, w.last_used, w.confidence FROM c LEFT JOIN w ON w.component_id = c.id),
p AS (SELECT *, CASE WHEN can_invoke THEN invoked ELSE loaded END AS primary_count, coalesce(epoch(TIMESTAMP '1998-08-02') - epoch(last_used) > (epoch(TIMESTAMP '1998-08-02') - epoch(TIMESTAMP '1996-01-01')) * 2 / 3, false) AS stale FROM r),
t AS (SELECT *, CASE WHEN NOT EXISTS (SELECT 1 FROM s WHERE started_at >= TIMESTAMP '1996-01-01') THEN 'no data' WHEN type = 'hook' THEN CASE WHEN invoked = 0 THEN 'never triggered' WHEN primary_count <= 2 OR stale THEN 'low-use' ELSE 'active' END
    WHEN invoked + loaded = 0 THEN 'unused' WHEN primary_count <= 2 OR stale THEN 'low-use' ELSE 'active' END AS base FROM p)
SELECT id AS component_id, type, CAST(invoked AS BIGINT) AS invoked, CAST(loaded AS BIGINT) AS loaded, CAST(primary_count AS BIGINT) AS primary_count, last_used, CAST(missed AS BIGINT) AS missed, confidence,
  base || CASE WHEN type = 'hook' AND invoked > 0 AND missed > 0 THEN ' (' || missed || ' MISS)' ELSE '' END || CASE WHEN NOT can_invoke AND invoked + loaded > 0 AND base <> 'never triggered' THEN ' (loaded)' ELSE '' END AS status FROM t""")
def window_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ninth session commits, and all hooks should see that."""
    sessions, uses, components = _archive(spark, sf_dir)
    committed = sessions.select("session_id", F.lit("r").alias("repo_id"), F.when(F.col("session_id") % 9 == 0, 1).otherwise(0).alias("commits"))
    hooks = components.withColumn("repo_id", F.lit("r")).withColumn("miss_when", F.when(F.col("type") == "hook", "git_commit"))
    missed = attribution.missed_hooks(committed, uses, hooks).select("component_id", "missed")
    return reports.window_report(sessions, uses, components, missed, START, AS_OF)


@query(USES + """ SELECT u.session_id, u.component_id, CASE max(CASE state WHEN 'invoked' THEN 2 WHEN 'loaded' THEN 1 ELSE 0 END) WHEN 2 THEN 'invoked' WHEN 1 THEN 'loaded' ELSE 'registered' END AS state FROM u GROUP BY u.session_id, u.component_id""")
def best_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, uses, components = _archive(spark, sf_dir)
    return reports.best_states(uses, components)


@query("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS sessions FROM orders GROUP BY 1) SELECT CAST(day AS VARCHAR) AS day, sessions FROM d
UNION ALL SELECT CAST(g AS VARCHAR), 0 FROM (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS g FROM d HAVING date_diff('day', min(day), max(day)) <= 40) WHERE g NOT IN (SELECT day FROM d)""")
def daily_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.daily_activity(_archive(spark, sf_dir)[0]).withColumn("day", F.col("day").cast("string"))


@query("SELECT o_orderkey AS session_id, o_orderdate AS started_at FROM orders WHERE o_orderdate >= TIMESTAMP '1998-07-03' ")
def sessions_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomline.sources import archive

    return archive.sessions_since(_archive(spark, sf_dir)[0], reports.since("30d", AS_OF))


@query("""WITH m AS (SELECT l_orderkey % 100 AS session_id, CAST(l_partkey % 20 AS VARCHAR) AS component_id, CASE l_returnflag WHEN 'R' THEN 'invoked' ELSE 'loaded' END AS state, l_orderkey AS idx, l_linenumber AS seq, CASE WHEN l_linestatus = 'F' THEN 'heuristic' ELSE 'exact' END AS confidence FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY session_id, component_id, state ORDER BY idx, seq) AS no FROM m)
SELECT session_id, component_id, state, count(*) AS count, max(confidence) AS confidence, string_agg(CASE WHEN no <= 50 THEN idx || '.' || seq END, ' ' ORDER BY idx, seq) AS evidence FROM n GROUP BY session_id, component_id, state""")
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 100).alias("session_id"), (F.col("l_partkey") % 20).cast("string").alias("component_id"), F.when(F.col("l_returnflag") == "R", "invoked").otherwise("loaded").alias("state"), F.col("l_orderkey").alias("idx"), F.col("l_linenumber").alias("seq"), F.when(F.col("l_linestatus") == "F", "heuristic").otherwise("exact").alias("confidence"), F.lit("").alias("summary"))
    return attribution.usages(rows).withColumn("evidence", F.array_join(F.transform("evidence", lambda x: F.format_string("%d.%d", x.idx, x.seq)), " "))


@query("""WITH r AS (SELECT l_orderkey AS session_id, 'f' || (l_partkey % 5) AS path, l_linenumber AS idx, l_shipmode AS tool FROM (SELECT *, CASE WHEN l_quantity < 25 THEN 'Read' ELSE 'Bash' END AS l_shipmode FROM lineitem)),
f AS (SELECT session_id, path, min(idx) AS first_idx, count(*) AS loads, max(CASE WHEN tool = 'Bash' THEN 'heuristic' ELSE 'exact' END) AS confidence, count(CASE WHEN tool = 'Read' THEN 1 END) AS reads FROM r GROUP BY ALL)
SELECT session_id, path, CAST(row_number() OVER (PARTITION BY session_id ORDER BY first_idx, path) AS INTEGER) AS no, first_idx, loads, reads, confidence FROM f""")
def file_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    tool = F.when(F.col("l_quantity") < 25, "Read").otherwise("Bash")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.format_string("f%d", F.col("l_partkey") % 5).alias("path"), F.col("l_linenumber").alias("idx"), F.lit(0).alias("seq"), tool.alias("tool"), F.when(tool == "Bash", "heuristic").otherwise("exact").alias("confidence"), T.read_range(F.col("l_linenumber"), F.lit(None).cast("int")).alias("range"))
    out = reports.file_loads(rows)
    return out.select("session_id", "path", "no", "first_idx", "loads", F.coalesce(F.try_element_at("by_tool", F.lit("Read")), F.lit(0)).cast("long").alias("reads"), "confidence")


@query("""SELECT code, n FROM (SELECT 'degraded' AS code, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS n FROM orders UNION ALL SELECT 'no data', count(CASE WHEN o_totalprice < 2000 THEN 1 END) FROM orders
UNION ALL SELECT 'unpriced', count(CASE WHEN o_orderkey % 7 = 0 THEN 1 END) FROM orders UNION ALL SELECT 'facts missing', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 10)) WHERE n > 0""")
def report_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "degraded").otherwise("ok")
    sessions = o.select(F.col("o_orderkey").alias("session_id"), status.alias("parse_status"), F.when(F.col("o_totalprice") < 2000, 0).otherwise(1).alias("turns"), F.when(F.col("o_orderkey") % 7 == 0, F.array(F.lit("x"))).otherwise(F.expr("cast(array() as array<string>)")).alias("unpriced"))
    covered = table(spark, sf_dir, "lineitem").where("l_quantity > 10").select(F.col("l_orderkey").alias("session_id"))
    return reports.warnings(sessions, covered)
