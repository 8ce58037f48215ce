"""Queries over texts, names, paths and documents: keys, parsing, resolution, inventory, guidance graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.operators import attribution, guidance, inventory, shell
from loomline.operators.facts import search_parts
from loomline.sources import archive, transcripts

from .registry import query, table

EST = "CAST(ceil(octet_length(encode({})) / 4.0) AS BIGINT)"


@query(f"SELECT conv_id, CAST(sum({EST.format('text')}) AS BIGINT) AS tokens, count(CASE WHEN role = 'user' THEN 1 END) AS turns FROM conversations GROUP BY conv_id")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.groupBy("conv_id").agg(F.sum(T.token_estimate("text")).alias("tokens"), F.count_if(F.col("role") == "user").alias("turns"))


@query("SELECT conv_id, turn, text AS scrubbed FROM conversations")
def scrubbed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control sequences put around texts come off again."""
    rows = table(spark, sf_dir, "conversations")
    loud = F.concat(F.lit("\x1b[1;31m"), F.regexp_replace("text", " ", " \x1b]0;title\x07"), F.lit("\x08\x7f\x1b[0m\x9b"))
    return rows.select("conv_id", "turn", T.scrub(loud).alias("scrubbed"))


PARTS = r"""WITH p AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'def ' || replace(p_name, ' ', '_') WHEN 1 THEN p_type || '\|' || p_brand WHEN 2 THEN '\b' || p_name || '\s+' WHEN 3 THEN 'import' WHEN 4 THEN p_name || '|  |len(' ELSE 'class' || chr(32) || p_name END AS pattern FROM part),
a AS (SELECT p_partkey, pattern, CASE WHEN len(l) > 0 THEN l ELSE [pattern] END AS l FROM (SELECT *, list_filter(string_split(replace(pattern, '\|', '|'), '|'), lambda x: trim(x) <> '') AS l FROM p)),
x AS (SELECT p_partkey, unnest(l) AS part, unnest(range(len(l))) AS part_no, len(l) AS parts FROM a),
t AS (SELECT *, trim(regexp_replace(part, '\\[A-Za-z][*+?]?|\{\d*,?\d*\}|[\^$]', ' ', 'g')) AS text FROM x),
d AS (SELECT *, string_split(lower(text), ' ')[1] IN ('def', 'class', 'function', 'func', 'fn', 'struct', 'interface', 'impl', 'trait', 'enum', 'const', 'import', 'from', 'use', 'require', '#include', 'package') AS decl,
  trim(substr(text, length(string_split(text, ' ')[1]) + 1)) AS rest, regexp_replace(lower(text), '[^0-9a-z]', '', 'g') IN ('len', 'self', 'this', 'super', 'return', 'import', 'print', 'init', 'main', 'async', 'await', 'yield', 'lambda', 'null', 'none', 'nil', 'true', 'false') AS common FROM t),
c AS (SELECT *, CASE WHEN decl THEN regexp_replace(lower(rest), '[^0-9a-z]', '', 'g') = '' ELSE common END AS structure, CASE WHEN decl AND regexp_replace(lower(rest), '[^0-9a-z]', '', 'g') <> '' AND NOT contains(rest, ' ') THEN rest ELSE part END AS word FROM d),
k AS (SELECT *, lower(regexp_replace(regexp_replace(regexp_replace(word, '\\[A-Za-z]', '', 'g'), '\{\d*,?\d*\}', '', 'g'), '[^0-9A-Za-z]', '', 'g')) AS folded FROM c)
SELECT p_partkey, CAST(part_no AS INTEGER) AS part_no, CAST(parts AS INTEGER) AS parts, CASE WHEN structure THEN 'mapping' ELSE 'search' END AS kind, CASE WHEN structure THEN 'code structure' WHEN length(folded) < 3 THEN lower(trim(word)) ELSE folded END AS key FROM k"""


@query(PARTS)
def search_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, name = F.col("p_partkey") % 6, F.col("p_name")
    pattern = F.when(m == 0, F.concat(F.lit("def "), F.replace(name, F.lit(" "), F.lit("_")))).when(m == 1, F.concat("p_type", F.lit("\\|"), "p_brand")).when(m == 2, F.concat(F.lit("\\b"), name, F.lit("\\s+"))).when(m == 3, "import").when(m == 4, F.concat(name, F.lit("|  |len("))).otherwise(F.concat(F.lit("class "), name))
    rows = table(spark, sf_dir, "part").select("p_partkey", pattern.alias("pattern"), F.lit(False).alias("glob"))
    return search_parts(rows).select("p_partkey", "part_no", "parts", "kind", "key")


@query("""WITH u AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS p, page_id % 3 AS r FROM pages),
s AS (SELECT page_id, r, list_filter(string_split(p, '/'), lambda x: x <> '' AND x <> '.') AS steps FROM u)
SELECT page_id, '/w/r' || r || '/' || array_to_string(steps, '/') AS whole, CASE WHEN r < 2 THEN array_to_string(steps, '/') END AS below, CASE WHEN r < 2 THEN len(steps) > 1 END AS in_site,
  CASE WHEN r < 2 THEN array_to_string(list_transform(range(1, len(steps)), lambda n: array_to_string(steps[1:n], '/')), ',') END AS above FROM s""")
def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' addresses as paths below one of three roots, written with a detour; two of the roots are known."""
    r = F.col("page_id") % 3
    root = F.format_string("/w/r%d", r)
    path = F.concat(F.lit("x/../"), F.regexp_replace("url", "^[a-z]+://", ""))
    whole = T.absolute_path(path, root)
    rows = table(spark, sf_dir, "pages").select("page_id", whole.alias("whole"), T.path_under(whole, F.when(r < 2, root).otherwise("/w/other")).alias("below"))
    site = F.substring_index("below", "/", 1)
    return rows.select("page_id", "whole", "below", (T.within("below", site) & (F.col("below") != site)).alias("in_site"), F.array_join(T.ancestors("below"), ",").alias("above"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber || '-' || CASE WHEN l_linenumber % 4 = 0 THEN CAST(l_linenumber + CAST(l_quantity AS BIGINT) - 1 AS VARCHAR) ELSE 'end' END END AS lines,
  CASE WHEN l_extendedprice * 10 <= 200000 THEN 200000 WHEN l_extendedprice * 10 <= 1000000 THEN 1000000 ELSE CAST(floor(l_extendedprice * 10) AS BIGINT) END AS scale, CAST(l_quantity AS BIGINT) // l_linenumber AS share,
  CASE WHEN l_partkey % 3 = 0 THEN 'srv' || (l_partkey % 5) END AS server FROM lineitem""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("long")
    span = T.read_range(F.when(n % 2 == 0, n), F.when(n % 4 == 0, q))
    lines = F.when(span.isNotNull(), F.concat(span.first.cast("string"), F.lit("-"), F.coalesce(span["last"].cast("string"), F.lit("end"))))
    peak = F.when(F.col("l_extendedprice") * 10 > 1_000_000, F.floor(F.col("l_extendedprice") * 10)).otherwise(F.ceil(F.col("l_extendedprice") * 10)).cast("long")
    tool = F.when(F.col("l_partkey") % 3 == 0, F.format_string("mcp__srv%d__do", F.col("l_partkey") % 5)).otherwise("Read")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", lines.alias("lines"), T.scale_tier(peak).alias("scale"), T.even_share(q, n).alias("share"), T.server_tool(tool).server.alias("server"))


def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcript lines: user and assistant turns, system turns as an unknown type, every tenth one broken."""
    c = table(spark, sf_dir, "conversations")
    stamp = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    usage = F.struct(F.length("text").cast("long").alias("input_tokens"), F.lit(7).alias("output_tokens"))
    call = F.struct(F.lit("tool_use").alias("type"), F.lit("").alias("text"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("id"), F.lit("Read").alias("name"), F.struct(F.lit("/r/a").alias("file_path")).alias("input"))
    said = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("struct<file_path:string>").alias("input"))
    kind = F.when(F.col("role") == "system", "odd").otherwise(F.col("role"))
    base = [kind.alias("type"), stamp.alias("timestamp"), F.lit("/r").alias("cwd"), F.lit("2.1.7").alias("version")]
    answer = F.to_json(F.struct(*base, F.struct(F.lit("m-1").alias("model"), usage.alias("usage"), F.array(said, call).alias("content")).alias("message")))
    other = F.to_json(F.struct(*base, F.struct(F.col("text").alias("content")).alias("message")))
    raw = F.when((F.col("conv_id") + F.col("turn")) % 10 == 0, "{broken").when(F.col("role") == "assistant", answer).otherwise(other)
    return c.select(F.col("conv_id").cast("string").alias("session_id"), F.lit(None).cast("string").alias("stream"), F.col("turn").alias("line_no"), raw.alias("raw"))


GOOD = "WITH c AS (SELECT *, (conv_id + turn) % 10 = 0 AS bad FROM conversations)"


@query(GOOD + """ SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS idx, CAST(0 AS INTEGER) AS seq, CASE role WHEN 'user' THEN 'user_msg' WHEN 'assistant' THEN 'assistant_msg' ELSE 'unknown' END AS kind,
  CASE WHEN role <> 'system' THEN text END AS text, CASE WHEN role = 'assistant' THEN length(text) END AS input, CAST(NULL AS VARCHAR) AS tool_name, CAST(1700000000 + turn * 60 AS BIGINT) AS at FROM c WHERE NOT bad
UNION ALL SELECT CAST(conv_id AS VARCHAR), turn, 1, 'tool_use', NULL, NULL, 'Read', CAST(1700000000 + turn * 60 AS BIGINT) FROM c WHERE NOT bad AND role = 'assistant'""")
def transcript_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = transcripts.events(transcripts.parsed_lines(transcript(spark, sf_dir)))
    return e.select("session_id", "idx", "seq", "kind", "text", F.col("usage.input").alias("input"), "tool_name", F.unix_timestamp("ts").alias("at"))


@query(GOOD + """ SELECT CAST(conv_id AS VARCHAR) AS session_id, CASE WHEN bool_or(NOT bad) THEN '2.1.7' END AS version, CASE WHEN bool_or(NOT bad) THEN '/r' END AS cwd, count(CASE WHEN bad THEN 1 END) AS bad_lines,
  count(CASE WHEN NOT bad AND role = 'system' THEN 1 END) AS unknown_lines, CASE WHEN bool_or(bad OR role = 'system') THEN 'degraded' ELSE 'ok' END AS parse_status FROM c GROUP BY conv_id""")
def transcript_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = transcripts.parsed_lines(transcript(spark, sf_dir))
    return transcripts.session_health(lines, transcripts.events(lines)).select("session_id", "version", "cwd", "bad_lines", "unknown_lines", "parse_status")


@query(GOOD + """ SELECT CAST(conv_id AS VARCHAR) AS session_id, count(CASE WHEN role = 'user' AND trim(text) <> '' THEN 1 END) AS turns, CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS input_tokens,
  substr(regexp_replace(arg_min(text, turn) FILTER (WHERE role = 'user' AND trim(text) <> ''), '\\s+', ' ', 'g'), 1, 80) AS prompt_digest FROM c WHERE NOT bad GROUP BY conv_id""".replace("\\\\", "\\"))
def session_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = transcripts.events(transcripts.parsed_lines(transcript(spark, sf_dir)))
    return attribution.session_stats(e).select("session_id", "turns", "input_tokens", "prompt_digest")


@query("""WITH r AS (SELECT conv_id, turn % 3 AS t, turn, text, row_number() OVER (PARTITION BY conv_id, turn % 3 ORDER BY turn) AS no FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS session_id, 't' || t AS tool_use_id, turn AS result_idx, text AS result_text FROM r WHERE no = 1""")
def first_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("idx"), F.lit(0).alias("seq"), F.lit("tool_result").alias("kind"), F.format_string("t%d", F.col("turn") % 3).alias("tool_use_id"), F.lit(False).alias("is_error"), "text")
    return transcripts.first_results(e).drop("result_error")


@query("""WITH s AS (SELECT c_custkey AS session_id, '/w/' || (c_nationkey % 5) || '/' || (c_custkey % 3) || '/src' AS cwd FROM customer), r(repo_id, root) AS (SELECT 'n' || n_nationkey, '/w/' || n_nationkey FROM nation UNION ALL SELECT 'deep', '/w/1/2')
SELECT session_id, arg_max(repo_id, length(root)) AS repo_id FROM s JOIN r ON cwd = root OR starts_with(cwd, root || '/') GROUP BY session_id""")
def session_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"), F.format_string("/w/%d/%d/src", F.col("c_nationkey") % 5, F.col("c_custkey") % 3).alias("cwd"))
    n = table(spark, sf_dir, "nation").select(F.format_string("n%d", "n_nationkey").alias("repo_id"), F.format_string("/w/%d", "n_nationkey").alias("root"))
    deep = n.limit(1).select(F.lit("deep").alias("repo_id"), F.lit("/w/1/2").alias("root"))
    return transcripts.owned_sessions(s, n.unionByName(deep)).select("session_id", "repo_id")


# --- the archive, on orders ---


@query("""SELECT o_orderkey AS session_id, CASE WHEN o_orderkey % 3 = 0 THEN 'new' WHEN o_orderkey % 5 = 0 THEN 'changed' WHEN o_orderkey % 7 = 0 THEN 'outdated' END AS reason FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 7 = 0""")
def ingest_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gate(spark, sf_dir).select("session_id", "reason")


def _gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("session_id")
    units = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").alias("modified"), F.length("o_orderpriority").alias("size"))
    have = units.where(k % 3 != 0).withColumn("size", F.when(k % 5 == 0, F.col("size") + 1).otherwise(F.col("size")))
    markers = units.select("session_id", F.explode(F.array(F.struct(F.lit("facts").alias("name"), F.when(k % 7 == 0, 1).otherwise(2).alias("version")), F.struct(F.lit("stale").alias("name"), F.lit(3).alias("version")))).alias("m")).select("session_id", "m.*")
    return archive.to_ingest(units, have, markers, {"facts": 2, "stale": 3})


@query("""SELECT count(CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 11 <> 0 THEN 1 END) AS new, count(CASE WHEN o_orderkey % 3 <> 0 AND (o_orderkey % 5 = 0 OR o_orderkey % 7 = 0) AND o_orderkey % 11 <> 0 THEN 1 END) AS updated,
  count(CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 THEN 1 END) AS skipped, count(CASE WHEN o_orderstatus = 'F' AND o_orderkey % 11 <> 0 AND (o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 7 = 0) THEN 1 END) AS degraded,
  count(CASE WHEN o_orderkey % 11 = 0 AND (o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 7 = 0) THEN 1 END) AS failed FROM orders""")
def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    health = o.select(F.col("o_orderkey").alias("session_id"), F.when(F.col("o_orderstatus") == "F", "degraded").otherwise("ok").alias("parse_status")).where("session_id % 11 <> 0")
    return archive.ingest_summary(o.select(F.col("o_orderkey").alias("session_id")), _gate(spark, sf_dir), health)


@query("SELECT c_custkey AS session_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def source_gone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.source_gone(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id")), table(spark, sf_dir, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("session_id")))


@query("""SELECT count(*) AS sessions, count(l.l_orderkey) AS covered, CAST(coalesce(sum(l.t), 0) AS BIGINT) AS tool_output_tokens FROM orders LEFT JOIN (SELECT l_orderkey, max(CAST(l_quantity AS BIGINT)) AS t FROM lineitem WHERE l_linenumber = 2 GROUP BY l_orderkey) l ON l.l_orderkey = o_orderkey""")
def facts_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").where("l_linenumber = 2").select(F.col("l_orderkey").alias("session_id"), F.lit("facts").alias("name"), F.col("l_quantity").cast("long").alias("tool_output_tokens"))
    return archive.coverage(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id")), m)


# --- attribution, on parts as components ---


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.format_string("r%d", n % 2).alias("repo_id"), n.cast("string").alias("id"), F.lit("skill").alias("type"), F.format_string("s%d", n % 400).alias("name"), F.when(n % 3 == 0, F.format_string("plugin:p%d", n % 4)).alias("source"), F.format_string("d%d/f%d.md", F.floor(n / 8), n % 4).alias("path"),
        F.format_string("event%d", F.floor(n / 10)).alias("hook_event"), F.array(F.format_string("run %d", n % 3)).alias("hook_commands"), F.when(n % 2 == 0, F.array(F.lit("loaded"), F.lit("invoked"))).otherwise(F.array(F.lit("loaded"))).alias("states"), F.lit(False).alias("missing"),
    )


COMPONENTS = "WITH c AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_partkey AS n, p_partkey % 2 AS r, 's' || (p_partkey % 400) AS name, CASE WHEN p_partkey % 3 = 0 THEN 'plugin:p' || (p_partkey % 4) END AS source, 'd' || (p_partkey // 8) AS dir, 'd' || (p_partkey // 8) || '/f' || (p_partkey % 4) || '.md' AS path, 'event' || (p_partkey // 10) AS ev FROM part)"


@query(COMPONENTS + """, k AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 's' || (o_orderkey % 500) ELSE 'p' || (o_orderkey % 4) || ':s' || (o_orderkey % 500) END AS name FROM orders),
x AS (SELECT k.o_orderkey, c.id, CASE WHEN k.name = c.name THEN 0 WHEN c.source = 'plugin:' || string_split(k.name, ':')[1] THEN 1 ELSE 2 END AS rank FROM k JOIN c ON c.name = string_split(k.name, ':')[-1] AND c.r = k.o_orderkey // 7 % 2),
b AS (SELECT *, min(rank) OVER (PARTITION BY o_orderkey) AS best FROM x)
SELECT o_orderkey AS session_id, id AS component_id, 'invoked' AS state, CASE WHEN count(*) OVER (PARTITION BY o_orderkey) > 1 THEN 'heuristic' ELSE 'exact' END AS confidence FROM b WHERE rank = best""")
def name_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    name = F.when(k % 2 == 0, F.format_string("s%d", k % 500)).otherwise(F.format_string("p%d:s%d", k % 4, k % 500))
    calls = table(spark, sf_dir, "orders").select(k.alias("session_id"), F.format_string("r%d", F.floor(k / 7) % 2).alias("repo_id"), F.lit(0).alias("idx"), F.lit(0).alias("seq"), name.alias("name"))
    return attribution.invoked_by_name(calls, _components(spark, sf_dir), "skill").select("session_id", "component_id", "state", "confidence")


@query(COMPONENTS + """, e AS (SELECT o_orderkey, 'event' || (o_orderkey % 300) AS ev, o_orderkey // 3 % 2 AS r, CASE WHEN o_orderkey % 4 <> 0 THEN 'sh run ' || (o_orderkey % 4) END AS cmd FROM orders),
x AS (SELECT e.o_orderkey, c.id, coalesce(contains(e.cmd, 'run ' || (c.n % 3)), false) AS fits FROM e JOIN c ON c.ev = e.ev AND c.r = e.r), y AS (SELECT *, count(*) OVER (PARTITION BY o_orderkey) AS n, bool_or(fits) OVER (PARTITION BY o_orderkey) AS fitting FROM x)
SELECT o_orderkey AS session_id, id AS component_id, 'heuristic' AS confidence FROM y WHERE n = 1 OR NOT fitting OR fits""")
def hook_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    e = table(spark, sf_dir, "orders").select(k.alias("session_id"), F.format_string("r%d", F.floor(k / 3) % 2).alias("repo_id"), F.lit(0).alias("idx"), F.lit(0).alias("seq"), F.lit("hook").alias("kind"), F.format_string("EVENT%d", k % 300).alias("hook_event"), F.when(k % 4 != 0, F.format_string("sh run %d", k % 4)).alias("text"))
    own = _components(spark, sf_dir).withColumn("type", F.lit("hook"))
    return attribution.invoked_hooks(e, own).select("session_id", "component_id", "confidence")


@query(COMPONENTS + """, l AS (SELECT l_orderkey, l_linenumber, l_suppkey % 2 AS r, 'd' || (l_partkey // 8) AS dir, 'd' || (l_partkey // 8) || '/f' || (l_partkey % 4) || '.md' AS path FROM lineitem)
SELECT l_orderkey AS session_id, id AS component_id, l_linenumber AS idx, 'exact' AS confidence FROM l JOIN c ON c.path = l.path AND c.r = l.r UNION ALL SELECT l_orderkey, id, l_linenumber, 'heuristic' FROM l JOIN c ON c.dir = l.dir AND c.r = l.r""")
def path_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _components(spark, sf_dir)
    n = F.col("l_partkey")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("idx"), F.lit(0).alias("seq"), F.format_string("r%d", F.col("l_suppkey") % 2).alias("repo_id"), F.format_string("d%d/f%d.md", F.floor(n / 8), n % 4).alias("path"))
    read = attribution.loaded_by_path(rows, c)
    touched = attribution.loaded_by_directory(rows, c)
    return read.unionByName(touched).select("session_id", "component_id", "idx", "confidence")


@query(COMPONENTS + """, m AS (SELECT l_orderkey AS session_id, CAST(l_partkey AS VARCHAR) AS component_id, l_linenumber AS idx, l_returnflag = 'R' AS inv, l_partkey % 2 = 0 AS can FROM lineitem)
SELECT session_id, component_id, idx, CASE WHEN inv THEN 'invoked' ELSE 'loaded' END AS state FROM m WHERE can OR NOT inv""")
def applicable_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_partkey").cast("string").alias("component_id"), F.col("l_linenumber").alias("idx"), F.when(F.col("l_returnflag") == "R", "invoked").otherwise("loaded").alias("state"))
    return attribution.applicable(rows, _components(spark, sf_dir))


@query("""WITH m AS (SELECT l_orderkey % 50 AS session_id, CAST(l_partkey % 40 AS VARCHAR) AS component_id, l_orderkey AS idx, l_linenumber AS seq, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS own FROM lineitem WHERE l_returnflag <> 'N'),
n AS (SELECT *, row_number() OVER (PARTITION BY session_id, component_id ORDER BY idx, seq, own DESC) AS no FROM m) SELECT session_id, component_id, idx, seq FROM n WHERE own = 0 OR no = 1""")
def first_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("session_id"), (F.col("l_partkey") % 40).cast("string").alias("component_id"), F.col("l_orderkey").alias("idx"), F.col("l_linenumber").alias("seq"), "l_returnflag")
    return attribution.first_per_session(rows.where("l_returnflag = 'R'"), rows.where("l_returnflag = 'A'")).select("session_id", "component_id", "idx", "seq")


# --- shell commands, made from line items ---


def _commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey")
    f = lambda s, *a: F.format_string(s, *a)
    cmd = (
        F.when(k % 6 == 0, f("cat a%d.py | grep -v x && rm b%d.py", k, k)).when(k % 6 == 1, f("grep -n -A 2 'key %d' src%d.py > out%d.txt", k, k, k)).when(k % 6 == 2, f("git -C /r commit -m 'a; b' ; git stash pop"))
        .when(k % 6 == 3, f("sed -i s/a/b/ c%d.py", k)).when(k % 6 == 4, f("ls x%d\nls y", k)).otherwise(f("echo 'open %d", k))
    )
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", k.alias("k"), cmd.alias("command"))


CMD = "WITH k AS (SELECT DISTINCT l_partkey AS k FROM lineitem)"


@query(CMD + """ SELECT CAST(k AS BIGINT) AS k, 'a' || k || '.py' AS path FROM k WHERE k % 6 = 0 UNION ALL SELECT k, 'src' || k || '.py' FROM k WHERE k % 6 = 1 UNION ALL SELECT k, 'out' || k || '.txt' FROM k WHERE k % 6 = 1""")
def shell_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _commands(spark, sf_dir).select("k", "command").distinct()
    return c.join(shell.read_paths(shell.segments(c)), "command").select("k", "path")


@query(CMD + """ SELECT CAST(k AS BIGINT) AS k, 'b' || k || '.py' AS path, 'rm' AS label FROM k WHERE k % 6 = 0 UNION ALL SELECT k, 'out' || k || '.txt', 'grep' FROM k WHERE k % 6 = 1 UNION ALL SELECT k, NULL, 'git stash pop' FROM k WHERE k % 6 = 2
UNION ALL SELECT k, 'c' || k || '.py', 'sed' FROM k WHERE k % 6 = 3""")
def shell_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _commands(spark, sf_dir).select("k", "command").distinct()
    return c.join(shell.mutations(shell.segments(c)), "command").select("k", "path", "label")


@query(CMD + """ SELECT CAST(k AS BIGINT) AS k, CAST(CASE WHEN k % 6 = 0 THEN 3 WHEN k % 6 IN (2, 4) THEN 2 ELSE 1 END AS BIGINT) AS segments, CAST(CASE WHEN k % 6 = 1 THEN 1 ELSE 0 END AS BIGINT) AS searches, CAST(CASE WHEN k % 6 = 4 THEN 1 ELSE 0 END AS BIGINT) AS layouts, false AS ls_only FROM k WHERE k % 6 <> 5""")
def shell_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _commands(spark, sf_dir).select("k", "command").distinct()
    return c.join(shell.call_summary(shell.segments(c)), "command").select("k", "segments", "searches", "layouts", "ls_only")


@query("SELECT l_orderkey AS session_id, count(*) AS commits FROM lineitem WHERE l_partkey % 6 = 2 AND l_linenumber % 2 = 0 GROUP BY l_orderkey")
def commit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _commands(spark, sf_dir)
    calls = c.select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("idx"), "command", F.when(F.col("l_linenumber") % 2 == 0, "[main 1a2b3c4d] done").otherwise("nothing to commit").alias("result_text"))
    return attribution.commit_counts(calls, shell.commits(shell.segments(c))).select("session_id", "commits")


# --- inventory ---


@query("""WITH o AS (SELECT p_name, min(p_partkey) AS id, arg_min(p_brand, p_partkey) AS notes, min(p_size) AS size FROM part WHERE p_partkey % 3 <> 0 GROUP BY p_name), n AS (SELECT p_name, max(p_partkey) AS id, arg_max(p_brand, p_partkey) AS notes, max(p_size) AS size FROM part WHERE p_partkey % 2 = 0 GROUP BY p_name)
SELECT coalesce(o.p_name, n.p_name) AS p_name, CASE WHEN n.p_name IS NOT NULL THEN n.size ELSE o.size END AS size, CASE WHEN o.p_name IS NOT NULL THEN o.id ELSE n.id END AS id, CASE WHEN o.p_name IS NOT NULL THEN o.notes ELSE n.notes END AS notes, n.p_name IS NULL AS missing FROM o FULL JOIN n ON o.p_name = n.p_name""")
def dimension_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    old = p.where("p_partkey % 3 <> 0").groupBy("p_name").agg(F.min("p_partkey").alias("id"), F.min_by("p_brand", "p_partkey").alias("notes"), F.min("p_size").alias("size"), F.lit(False).alias("missing"))
    new = p.where("p_partkey % 2 = 0").groupBy("p_name").agg(F.max("p_partkey").alias("id"), F.max_by("p_brand", "p_partkey").alias("notes"), F.max("p_size").alias("size"))
    return inventory.refreshed(old, new, ["p_name"], ["id", "notes"])


@query("""WITH c AS (SELECT p_partkey, p_size % 4 AS repo_id, 's:' || p_brand AS id, CASE WHEN p_partkey % 2 = 0 THEN 'local' ELSE 'plugin' END AS provenance FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY repo_id, id ORDER BY p_partkey) AS no FROM c),
a AS (SELECT *, row_number() OVER (PARTITION BY repo_id, id, provenance, no > 1 ORDER BY p_partkey) AS again FROM n) SELECT p_partkey, repo_id, provenance, CASE WHEN no = 1 THEN id ELSE id || '@' || provenance || CASE WHEN again > 1 THEN '-' || again ELSE '' END END AS id FROM a""")
def unique_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 4).alias("repo_id"), F.concat(F.lit("s:"), "p_brand").alias("id"), F.when(F.col("p_partkey") % 2 == 0, "local").otherwise("plugin").alias("provenance"))
    return inventory.unique_ids(p, ["p_partkey"])


@query("""WITH c AS (SELECT p_brand AS type, CASE WHEN p_size % 2 = 0 THEN 'local' ELSE 'plugin' END AS provenance, CASE WHEN p_partkey % 3 = 0 THEN 'static' ELSE 'dynamic' END AS context, CAST(p_size AS BIGINT) AS t FROM part)
SELECT type, provenance, count(*) AS components, CAST(sum(CASE WHEN context = 'static' THEN t ELSE 0 END) AS BIGINT) AS static_tokens, CAST(sum(CASE WHEN context <> 'static' THEN t ELSE 0 END) AS BIGINT) AS dynamic_tokens FROM c GROUP BY GROUPING SETS ((type), (provenance), ())""")
def inventory_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("type"), F.when(F.col("p_size") % 2 == 0, "local").otherwise("plugin").alias("provenance"), F.when(F.col("p_partkey") % 3 == 0, "static").otherwise("dynamic").alias("context"), F.col("p_size").cast("long").alias("tokens_est"))
    return inventory.summary(p)


def _repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files of skill and command folders."""
    n = F.col("p_partkey")
    path = F.when(n % 4 == 0, F.format_string(".claude/skills/s%d/SKILL.md", n)).when(n % 4 == 1, F.format_string(".claude/commands/g/c%d.md", n)).when(n % 4 == 2, F.format_string(".claude/agents/a%d.md", n)).otherwise(F.format_string("d%d/CLAUDE.md", n))
    text = F.when(n % 4 == 0, F.concat(F.lit("---\nname: "), "p_name", F.lit("\n---\n"), "p_type")).otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").select((n % 10).alias("repo_id"), path.alias("path"), text.alias("text"), n)


@query(f"""SELECT p_partkey % 10 AS repo_id, CASE p_partkey % 4 WHEN 0 THEN 'skill:s' WHEN 1 THEN 'command:g:c' WHEN 2 THEN 'agent:a' ELSE 'guide:d' END || p_partkey AS id,
  CASE WHEN p_partkey % 4 = 0 THEN CAST(ceil((octet_length(encode(p_name)) + octet_length(encode(p_type)) + 15) / 4.0) AS BIGINT) ELSE {EST.format('p_type')} END AS tokens_est,
  CASE WHEN p_partkey % 4 = 0 THEN CAST(ceil((octet_length(encode(p_name)) + 8) / 4.0) AS BIGINT) END AS tokens_meta_est FROM part""")
def component_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.scan(_repo(spark, sf_dir)).select("repo_id", "id", "tokens_est", "tokens_meta_est")


@query(f"""SELECT 'skill:s' || p_partkey AS id, CAST(ceil((octet_length(encode(p_name)) + 8) / 4.0) AS BIGINT) AS static_tokens FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT 'agent:a' || p_partkey, {EST.format('p_type')} FROM part WHERE p_partkey % 4 = 2""")
def static_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.static_tokens(inventory.scan(_repo(spark, sf_dir))).drop("repo_id")


STATIC = f"""s AS (SELECT p_partkey % 10 AS repo_id, 'skill:s' || p_partkey AS id, 'skill' AS type, CAST(ceil((octet_length(encode(p_name)) + 8) / 4.0) AS BIGINT) AS always, CAST(ceil((octet_length(encode(p_type)) + 1) / 4.0) AS BIGINT) AS used FROM part WHERE p_partkey % 4 = 0
  UNION ALL SELECT p_partkey % 10, CASE p_partkey % 4 WHEN 1 THEN 'command:g:c' WHEN 2 THEN 'agent:a' ELSE 'guide:d' END || p_partkey, CASE p_partkey % 4 WHEN 1 THEN 'command' WHEN 2 THEN 'agent' ELSE 'guide' END,
    CASE WHEN p_partkey % 4 = 2 THEN {EST.format('p_type')} ELSE 0 END, CASE WHEN p_partkey % 4 <> 2 THEN {EST.format('p_type')} ELSE 0 END FROM part WHERE p_partkey % 4 <> 0)"""


@query(f"""WITH {STATIC}, n AS (SELECT repo_id, id, always, row_number() OVER (PARTITION BY repo_id ORDER BY always DESC, id) AS no, sum(always) OVER (PARTITION BY repo_id) AS total FROM s WHERE always > 0)
SELECT repo_id, no, id, always AS static_tokens, round(always * 100.0 / total, 1) AS share FROM n WHERE no <= 12""")
def inventory_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.largest(inventory.scan(_repo(spark, sf_dir)))


@query(f"""WITH {STATIC} SELECT type, CASE WHEN grouping(provenance) = 0 THEN provenance END AS provenance, count(*) AS components, CAST(sum(always) AS BIGINT) AS static_tokens, CAST(sum(used) AS BIGINT) AS dynamic_tokens
FROM (SELECT *, 'local' AS provenance FROM s) GROUP BY GROUPING SETS ((type), (provenance), ())""")
def inventory_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary where skills stand with their front matter in one column and their body in the other."""
    return inventory.summary(inventory.scan(_repo(spark, sf_dir)))


# --- guidance graph: pages lead to pages that share a link ---


@query("SELECT raw, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\" )]+)\"', 1)) AS raw FROM pages) GROUP BY raw")
def link_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of a page as a guidance document would write them, found again."""
    hrefs = F.regexp_extract_all("html", F.lit('href="([^" )]+)"'), 1)
    text = F.array_join(F.transform(hrefs, lambda h: F.concat(F.lit("- [x]("), h, F.lit(")"))), "\n")
    links = guidance.candidates(table(spark, sf_dir, "pages").select("page_id", text.alias("text"))).where("context = 'link'")
    return links.groupBy("raw").agg(F.countDistinct("page_id").alias("pages"))


@query("""WITH RECURSIVE n AS (SELECT max(s_suppkey) + 1 AS n FROM supplier), g AS (SELECT s_suppkey AS s, (s_suppkey * 3 + s_nationkey) % n AS t, s_suppkey % 5 = 0 AS free FROM supplier, n UNION SELECT s_suppkey, (s_suppkey * 2) % n, false FROM supplier, n),
r(node, hop) AS (SELECT s_suppkey, 0 FROM supplier WHERE s_suppkey % 50 = 1 UNION SELECT g.t, r.hop + CASE WHEN g.free THEN 0 ELSE 1 END FROM r JOIN g ON g.s = r.node WHERE r.hop < 40)
SELECT CAST(node AS VARCHAR) AS node, CAST(min(hop) AS INTEGER) AS hop FROM r GROUP BY node""")
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers lead to one another; every fifth's first edge is free."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    n = s.agg(F.max(k) + 1).first()[0]
    edge = lambda to: s.select(F.lit("r").alias("repo_id"), k.cast("string").alias("source"), (to % n).cast("long").cast("string").alias("target"), k)
    one, two = edge(k * 3 + F.col("s_nationkey")), edge(k * 2)
    paid = one.where(k % 5 != 0).unionByName(two).drop("s_suppkey").distinct().withColumn("kind", F.lit("reference"))
    starts = s.where(k % 50 == 1).select(F.lit("r").alias("repo_id"), k.cast("string").alias("node"))
    return guidance.reach(starts, paid, one.where(k % 5 == 0).drop("s_suppkey")).select("node", "hop")


LINES = r"""WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\n\z', ''), chr(10))) AS line, unnest(range(1, len(string_split(regexp_replace(text, '\n\z', ''), chr(10))) + 1)) AS line_no FROM documents),
f AS (SELECT *, count(CASE WHEN starts_with(trim(line), '```') THEN 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS fences FROM l),
k AS (SELECT doc_id, line_no, line, CASE WHEN starts_with(trim(line), '```') OR fences % 2 = 1 THEN 'code' WHEN trim(line) = '' THEN 'blank' WHEN NOT regexp_matches(trim(line), '[^|\-:=+ ]') THEN 'structural' WHEN starts_with(trim(line), '#') THEN 'heading' ELSE 'prose' END AS kind FROM f)"""


@query(LINES + " SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, kind FROM k")
def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guidance.classified_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "line_no", "kind")


@query(LINES + f""" SELECT doc_id, count(CASE WHEN kind = 'prose' THEN 1 END) AS prose, count(CASE WHEN kind = 'heading' THEN 1 END) AS heading, count(CASE WHEN kind = 'blank' THEN 1 END) AS blank, count(CASE WHEN kind = 'code' THEN 1 END) AS code, CAST(sum({EST.format('line')}) AS BIGINT) AS tokens FROM k GROUP BY doc_id""")
def carrier_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = guidance.classified_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return guidance.carrier_rollup(lines, ["doc_id"]).select("doc_id", "prose", "heading", "blank", "code", "tokens")


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repository per supplier's part list: code files and a guide that names some of them."""
    n = F.col("p_partkey")
    path = F.format_string("m%d/f%d.py", n % 3, n)
    code = F.when(n % 11 == 0, "def (:").otherwise(F.concat(F.lit("def a():\n    pass\n"), F.when(n % 2 == 0, "class B:\n    def c(self):\n        pass\n").otherwise("")))
    files = table(spark, sf_dir, "part").select(F.format_string("r%d", n % 10).alias("repo_id"), path.alias("path"), code.alias("text"))
    named = F.array_join(F.array_sort(F.collect_list(F.when(n % 4 == 0, F.concat(F.lit("See `"), path, F.lit("` and m9/gone"), n.cast("string"), F.lit(".py."))))), "\n")
    guides = table(spark, sf_dir, "part").groupBy(F.format_string("r%d", n % 10).alias("repo_id")).agg(named.alias("text")).withColumn("path", F.lit("CLAUDE.md"))
    return files.unionByName(guides)


TREE = "WITH f AS (SELECT 'r' || (p_partkey % 10) AS repo_id, p_partkey AS n, 'm' || (p_partkey % 3) || '/f' || p_partkey || '.py' AS path FROM part)"


def _edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    files = _tree(spark, sf_dir)
    index = guidance.written(guidance.file_index(files), "index")
    carriers = files.where("path LIKE '%.md'").select("repo_id", F.col("path").alias("carrier"), "text")
    edges, dead = guidance.references(guidance.written(guidance.candidates(carriers), "candidates"), index, files.select("repo_id", "path"))
    return index, edges, dead


@query(TREE + " SELECT repo_id, 'CLAUDE.md' AS carrier, path AS target, 'inline' AS context, 'exact' AS confidence FROM f WHERE n % 4 = 0")
def reference_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)[1].select("repo_id", "carrier", "target", "context", "confidence")


@query(TREE + " SELECT repo_id, 'CLAUDE.md' AS carrier, 'm9/gone' || n || '.py' AS raw, 'prose' AS context FROM f WHERE n % 4 = 0")
def dead_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)[2]


def _costs(spark: SparkSession, sf_dir: str, index: DataFrame) -> DataFrame:
    """Line items as facts: returned ones opened the file of their part, the others searched by its key."""
    n = F.col("l_partkey")
    path = F.format_string("m%d/f%d.py", n % 3, n)
    rows = table(spark, sf_dir, "lineitem").select(F.format_string("r%d", n % 10).alias("repo_id"), F.when(F.col("l_returnflag") == "R", "chain_read").otherwise("search").alias("kind"), F.format_string("k%d", n).alias("key"), path.alias("raw"), F.col("l_quantity").cast("long").alias("tokens_est"))
    return guidance.search_costs(rows, index)


def _reached(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    index, edges, _ = _edges(spark, sf_dir)
    starts = index.where("path = 'CLAUDE.md'").select("repo_id", F.col("path").alias("node"))
    links = edges.select("repo_id", F.col("carrier").alias("source"), "target", F.lit("reference").alias("kind"))
    return index, guidance.reach(starts, guidance.written(links, "links"), guidance.written(guidance.guide_chain(index), "chain"))


COST = """, l AS (SELECT l_partkey AS n, l_returnflag = 'R' AS opened, CAST(l_quantity AS BIGINT) AS t FROM lineitem), cost AS (SELECT n, CAST(coalesce(sum(CASE WHEN NOT opened THEN t END), 0) AS BIGINT) AS tokens,
  greatest(count(CASE WHEN NOT opened THEN 1 END), 1) AS searches FROM l GROUP BY n HAVING bool_or(opened))"""


@query(TREE + COST + " SELECT f.repo_id, f.path, CASE WHEN f.n % 11 = 0 THEN NULL WHEN f.n % 2 = 0 THEN 3 ELSE 1 END AS defs, coalesce(tokens, 0) AS tokens, coalesce(searches, 0) AS searches FROM f LEFT JOIN cost ON cost.n = f.n WHERE f.n % 4 <> 0")
def unreached_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, reached = _reached(spark, sf_dir)
    cover = guidance.coverage(index, reached, guidance.symbol_counts(_tree(spark, sf_dir)), _costs(spark, sf_dir, index))
    return guidance.unreached(cover).select("repo_id", "path", "defs", "tokens", "searches")


@query(TREE + " SELECT repo_id, CAST(count(*) + 1 AS BIGINT) AS files, CAST(count(CASE WHEN n % 4 = 0 THEN 1 END) + 1 AS BIGINT) AS reached, CASE WHEN bool_or(n % 4 = 0) THEN 1 ELSE 0 END AS deepest, CAST(0 AS BIGINT) AS beyond_three, CAST(1 AS BIGINT) AS at_start FROM f GROUP BY repo_id")
def file_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guidance.file_rollup(*_reached(spark, sf_dir)).select("repo_id", "files", "reached", "deepest", "beyond_three", F.try_element_at("hops", F.lit(0)).alias("at_start"))


@query(TREE + """, l AS (SELECT 'r' || (p_partkey % 10) AS repo_id, p_partkey AS n, CASE p_partkey % 3 WHEN 0 THEN 'bare' WHEN 1 THEN 'echo' ELSE 'said' END AS label FROM part WHERE p_partkey % 4 = 0)
SELECT repo_id, count(*) AS routing, count(CASE WHEN label = 'bare' THEN 1 END) AS bare, count(CASE WHEN label = 'echo' THEN 1 END) AS echo, CAST(1 AS BIGINT) AS prose, CAST(1 AS BIGINT) AS prose_before_routing FROM l GROUP BY repo_id""")
def routing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A guide for each repository: a line for every fourth part's file, with no label, one that repeats the path, or one that says more."""
    n = F.col("p_partkey")
    path = F.format_string("m%d/f%d.py", n % 3, n)
    label = F.when(n % 3 == 0, F.lit("- ")).when(n % 3 == 1, F.format_string("m%d f%d: ", n % 3, n)).otherwise(F.lit("orders: "))
    line = F.when(n % 4 == 0, F.struct(n.alias("n"), F.concat(label, path).alias("line")))
    own = table(spark, sf_dir, "part").groupBy(F.format_string("r%d", n % 10).alias("repo_id")).agg(F.array_sort(F.collect_list(line)).alias("l")).where("size(l) > 0")
    docs = own.select("repo_id", F.lit("CLAUDE.md").alias("carrier"), F.concat(F.lit("what lies where\n"), F.array_join(F.col("l.line"), "\n")).alias("text"))
    files = _tree(spark, sf_dir)
    lines = guidance.classified_lines(docs)
    found = guidance.written(guidance.candidates(lines), "candidates")
    edges, _ = guidance.references(found, guidance.file_index(files), files.select("repo_id", "path"))
    per_line = found.join(edges.select("repo_id", "carrier", "raw", "target"), ["repo_id", "carrier", "raw"]).select("repo_id", "carrier", "line_no", "raw", "target").distinct()
    lines = guidance.labelled(guidance.routed(lines, per_line), per_line)
    return guidance.carrier_rollup(lines, ["repo_id", "carrier"]).select("repo_id", "routing", "bare", "echo", "prose", "prose_before_routing")


@query(TREE + """ SELECT repo_id, count(*) AS code_files, count(CASE WHEN n % 4 = 0 THEN 1 END) AS reached_files, CAST(sum(CASE WHEN n % 11 = 0 THEN 0 WHEN n % 2 = 0 THEN 3 ELSE 1 END) AS BIGINT) AS symbols,
  CAST(coalesce(sum(CASE WHEN n % 4 = 0 AND n % 11 <> 0 THEN 3 END), 0) AS BIGINT) AS reached_symbols, count(CASE WHEN n % 11 = 0 THEN 1 END) AS unparsed FROM f GROUP BY repo_id""")
def map_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, reached = _reached(spark, sf_dir)
    files = _tree(spark, sf_dir)
    cover = guidance.coverage(index, reached, guidance.symbol_counts(files), _costs(spark, sf_dir, index))
    return guidance.map_rollup(cover).select("repo_id", "code_files", "reached_files", "symbols", "reached_symbols", "unparsed")


@query("""WITH f AS (SELECT 'r' || (l_suppkey % 4) AS repo_id, CASE WHEN l_returnflag = 'R' THEN 'chain_read' ELSE 'search' END AS kind, 'k' || (l_partkey % 30) AS key, 'd/f' || l_partkey || '.py' AS raw, CAST(l_quantity AS BIGINT) AS t FROM lineitem),
o AS (SELECT DISTINCT repo_id, key, raw FROM f WHERE kind = 'chain_read'), s AS (SELECT repo_id, key, sum(t) AS t, count(*) AS n FROM f WHERE kind = 'search' GROUP BY ALL)
SELECT o.repo_id, o.raw AS path, CAST(coalesce(sum(s.t), 0) AS BIGINT) AS tokens, CAST(sum(greatest(coalesce(s.n, 0), 1)) AS BIGINT) AS searches FROM o LEFT JOIN s ON s.repo_id = o.repo_id AND s.key = o.key WHERE CAST(regexp_extract(o.raw, '[0-9]+') AS INTEGER) % 3 <> 0 GROUP BY o.repo_id, o.raw""")
def search_cost_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.format_string("r%d", F.col("l_suppkey") % 4).alias("repo_id"), F.when(F.col("l_returnflag") == "R", "chain_read").otherwise("search").alias("kind"), F.format_string("k%d", F.col("l_partkey") % 30).alias("key"), F.format_string("d/f%d.py", F.col("l_partkey")).alias("raw"), F.col("l_quantity").cast("long").alias("tokens_est"))
    every = F.explode(F.array(*[F.lit(f"r{k}") for k in range(4)]))  # files of the parts not divisible by three, in each repository
    files = table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select(every.alias("repo_id"), F.format_string("d/f%d.py", "p_partkey").alias("path"))
    return guidance.search_costs(rows, guidance.file_index(files))


@query(TREE + " SELECT repo_id, string_agg(path, chr(10) ORDER BY path) AS text FROM (SELECT repo_id, path FROM f UNION ALL SELECT DISTINCT repo_id, 'CLAUDE.md' FROM f) GROUP BY repo_id HAVING count(*) <= 300 UNION ALL "
  "SELECT repo_id, string_agg(top || ' (' || n || ')', chr(10) ORDER BY top) FROM (SELECT repo_id, top, count(*) AS n FROM (SELECT repo_id, split_part(path, '/', 1) || '/' AS top FROM f UNION ALL SELECT DISTINCT repo_id, 'CLAUDE.md' FROM f) GROUP BY repo_id, top) GROUP BY repo_id HAVING sum(n) > 300")
def map_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guidance.skeleton(guidance.file_index(_tree(spark, sf_dir)))


@query("""WITH f AS (SELECT p_partkey AS n, 'r' || (p_partkey % 10) AS repo_id, p_partkey % 3 = 0 OR p_partkey % 7 = 0 AS held FROM part)
SELECT DISTINCT repo_id, 'auto-inject' AS what, 'CLAUDE.md' AS node, NULL AS raw FROM f UNION ALL SELECT DISTINCT repo_id, 'dir-entry', 'sub/CLAUDE.md', NULL FROM f
UNION ALL SELECT repo_id, 'import', 'docs/p' || n || '.md', NULL FROM f WHERE held UNION ALL SELECT repo_id, 'import', 'docs/q' || n || '.md', NULL FROM f WHERE held AND n % 2 = 0
UNION ALL SELECT repo_id, 'external', 'docs/p' || n || '.md', 'docs/q' || n || '.md' FROM f WHERE held AND n % 2 = 1 UNION ALL SELECT repo_id, 'dead', 'docs/p' || n || '.md', 'src/gone' || n || '.py' FROM f WHERE held
UNION ALL SELECT repo_id, 'lazy', 'docs/x' || n || '.md', NULL FROM f WHERE held""")
def import_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guidance that imports documents from its own directory and from the root: how each comes into context, imports that lead outside, dead routes, documents read on demand."""
    from loomline.operators import routemap

    n, part = F.col("p_partkey"), table(spark, sf_dir, "part")
    repo = F.format_string("r%d", n % 10).alias("repo_id")
    doc = lambda name, text, when=F.lit(True): part.where(when).select(repo, F.format_string(name, n).alias("path"), text.alias("text"))
    files = doc("docs/p%d.md", F.format_string("see @docs/q%d.md\nand src/gone%d.py or docs/x%d.md", n, n, n)).unionByName(doc("docs/q%d.md", F.lit("end"), n % 2 == 0)).unionByName(doc("docs/x%d.md", F.lit("more")))
    lead = lambda path, form, when: part.groupBy(repo).agg(F.concat(F.lit("what is where\n"), F.array_join(F.array_sort(F.collect_list(F.when(when, F.format_string(form, n)))), "\n")).alias("text")).select("repo_id", F.lit(path).alias("path"), "text")
    files = files.unionByName(lead("CLAUDE.md", "@docs/p%d.md", n % 3 == 0)).unionByName(lead("sub/CLAUDE.md", "@docs/p%d.md", n % 7 == 0))
    found = routemap.guidance_map(files)
    row = lambda df, what, node, raw=None: df.select("repo_id", (F.col(what) if what in df.columns else F.lit(what)).alias("what"), F.col(node).alias("node"), (F.col(raw) if raw else F.lit(None).cast("string")).alias("raw"))
    out = row(found["carriers"], "loading", "carrier").unionByName(row(found["imports_external"], "external", "carrier", "raw")).unionByName(row(found["dead_routes"], "dead", "carrier", "raw"))
    return out.unionByName(row(found["lazy"], "lazy", "node"))


@query("""WITH p AS (SELECT s_suppkey AS n, s_nationkey AS h FROM supplier WHERE s_suppkey % 2 = 0), r AS (SELECT n_nationkey AS h, 'r' || n_nationkey AS repo_id FROM nation UNION ALL SELECT n_nationkey, 'x' || n_nationkey FROM nation WHERE n_nationkey % 2 = 0),
c AS (SELECT h, 'skill:s' || n AS id, 'plugin:p' || n AS source, false AS own FROM p UNION ALL SELECT h, 'command:go', 'plugin:p' || n, false FROM p UNION ALL SELECT h, 'server:db', 'plugin:p' || n, false FROM p WHERE n % 4 = 0),
a AS (SELECT r.repo_id, c.id, c.source, own FROM r JOIN c ON c.h = r.h UNION ALL SELECT repo_id, 'command:go', NULL, true FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY repo_id, id ORDER BY NOT own, source) AS no FROM a)
SELECT repo_id, id || CASE WHEN no = 1 THEN '' WHEN no = 2 THEN '@plugin' ELSE '@plugin-' || (no - 1) END AS id, source FROM k""")
def plugin_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers are plugins of their nation's home, every second one enabled; repositories have a command of their own that plugins have, too."""
    s, n = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    home = F.col("s_nationkey").alias("home_id")
    entry = F.format_string('"p%d@m": [{"installPath": "/plug/p%d/"}]', n, n)
    on = F.format_string('"p%d@m": %s', n, F.when(n % 2 == 0, "true").otherwise("false"))
    doc = lambda form, each: F.format_string(form, F.array_join(F.array_sort(F.collect_list(each)), ", ")).alias("text")
    homes = s.groupBy(home).agg(doc('{"enabledPlugins": {%s}}', on)).withColumn("path", F.lit(inventory.HOME_SETTINGS)).unionByName(s.groupBy(home).agg(doc('{"plugins": {%s}}', entry)).withColumn("path", F.lit(inventory.HOME_PLUGINS)))
    file = lambda form, text, *arg: s.select(home, F.format_string(form, *arg).alias("path"), text.alias("text"))
    trees = file("/plug/p%d/skills/s%d/SKILL.md", F.col("s_name"), n, n).unionByName(file("/plug/p%d/commands/go.md", F.col("s_name"), n)).unionByName(file("/plug/p%d/.mcp.json", F.when(n % 4 == 0, F.lit('{"mcpServers": {"db": {"command": "x"}}}')).otherwise("{"), n)).unionByName(file("/other/skills/s%d/SKILL.md", F.col("s_name"), n))
    k = F.col("n_nationkey")
    repos = table(spark, sf_dir, "nation").select(k.alias("home_id"), F.explode(F.array_compact(F.array(F.format_string("r%d", k), F.when(k % 2 == 0, F.format_string("x%d", k))))).alias("repo_id"))
    own = repos.select("repo_id", F.lit(".claude/commands/go.md").alias("path"), F.lit("go").alias("text"))
    return inventory.scan(own, inventory.plugin_scan(homes, trees, repos)).select("repo_id", "id", "source")
