"""What a session had to find out for itself: searches, layout probes, files opened from search results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import text as T

from . import shell, windows
from .joins import spread
from .windows import SIDE

RAW = 200


def search_parts(calls: DataFrame, pattern: str = "pattern", glob: str = "glob") -> DataFrame:
    """calls exploded to their alternatives: part_no, kind, key, raw, confidence, parts."""
    parts = calls.withColumn("alts", T.alternatives(pattern)).withColumn("parts", F.size("alts"))
    parts = parts.select("*", F.posexplode("alts").alias("part_no", "part")).drop("alts")
    found = T.syntax_class("part", F.col(glob))
    parts = parts.withColumn("c", found)
    word = F.coalesce("c.keyword", "part")
    return parts.select(
        "*", F.when(F.col("c.structure"), "mapping").otherwise("search").alias("kind"),
        F.when(F.col("c.structure"), T.CODE_KEY).otherwise(T.canonical_key(word)).alias("key"),
        F.left(T.scrub(T.strip("part")), F.lit(RAW)).alias("raw"), F.when(F.col("c.structure"), F.col("c.confidence")).otherwise("exact").alias("confidence"),
    ).drop("c", "part")


def merged(facts: DataFrame) -> DataFrame:
    """One fact per (session, idx, kind, key): tokens added, heuristic if any is, the first raw and tool, by seq and, where the facts have one, by no."""
    key = ["session_id", *SIDE, "idx", "kind", "key"]
    first = F.min_by(F.struct("raw", "tool"), F.struct("seq", "no") if "no" in facts.columns else F.col("seq"))
    out = facts.groupBy(*key).agg(first.alias("f"), F.sum("tokens_est").alias("tokens_est"), F.max("confidence").alias("confidence"))
    return out.select(*key, "f.raw", "f.tool", "tokens_est", "confidence")


def chain_reads(stream: DataFrame, window: list[str] = SIDE) -> DataFrame:
    """Reads of files that the last search of their window turned up, if another search follows.

    stream: (session_id, window, idx, seq, op search or read, key, path, cwd, text, tokens, and root where known). Paths below root are
    given relative to it. Only positions go through the window; the search's text is joined back for the reads that need it.
    """
    key = ["session_id", *window]
    at = F.struct("idx", "seq")
    order = Window.partitionBy(*key).orderBy("idx", "seq")
    root = F.col("root") if "root" in stream.columns else F.lit(None).cast("string").alias("root")
    narrow = stream.select(*key, "idx", "seq", "op", "path", "cwd", "tokens", root).withColumn("here", F.when(F.col("op") == "search", at))
    narrow = narrow.withColumn("last", F.last("here", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    narrow = narrow.withColumn("next", F.first("here", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)))
    reads = narrow.where("op = 'read' AND last IS NOT NULL AND next IS NOT NULL").withColumn("s_idx", F.col("last.idx")).withColumn("s_seq", F.col("last.seq"))
    found = stream.where("op = 'search'").select(F.col("session_id").alias("s_id"), F.col("idx").alias("s_idx"), F.col("seq").alias("s_seq"), F.col("key").alias("key"), F.col("text").alias("found"))
    hit = reads.join(spread(found), (reads.session_id == found.s_id) & (reads.s_idx == found.s_idx) & (reads.s_seq == found.s_seq))
    hit = hit.where(T.path_in_text(F.col("path"), F.col("found"), F.col("cwd")))
    raw = F.coalesce(T.relative_path("path", F.regexp_replace("root", "/+$", "")), "path")
    return hit.select(*key, reads.idx, reads.seq, F.lit("chain_read").alias("kind"), "key", F.left(T.scrub(raw), F.lit(RAW)).alias("raw"), F.lit("Read").alias("tool"), F.col("tokens").alias("tokens_est"), F.lit("heuristic").alias("confidence"))


def looked_for(calls: DataFrame, key: list[str]) -> DataFrame:
    """calls (key, tool_name, items, out, tokens) as one row for each thing they looked for, in order ``no``: kind, key, raw, tool, tokens_est, confidence.

    A result's tokens go in even shares to all that its call looked for.
    """
    rows = calls.select(*key, "tool_name", "out", "tokens", F.inline("items"))
    alternatives = F.when(F.col("layout").isNull(), T.alternatives("pattern")).otherwise(F.array(F.col("layout")))
    rows = rows.select("*", F.posexplode(alternatives).alias("part_no", "part")).withColumn("c", T.syntax_class("part", F.col("glob")))
    layout, structure = F.col("layout").isNotNull(), F.col("c.structure")
    word = F.coalesce("c.keyword", "part")
    rows = rows.select(
        *key, "out", "tokens", F.struct("seg_no", "probe_no", "part_no").alias("no"), F.when(layout | structure, "mapping").otherwise("search").alias("kind"),
        F.when(layout, F.lit(T.LAYOUT_KEY)).when(structure, F.lit(T.CODE_KEY)).otherwise(T.canonical_key(word)).alias("of"),
        F.left(T.scrub(T.strip("part")), F.lit(RAW)).alias("raw"), F.when((F.col("tool_name") == "Bash") & (layout | structure), "Bash").otherwise(F.col("label")).alias("tool"),
        F.when(~layout & structure, F.col("c.confidence")).otherwise(F.col("confidence")).alias("confidence"), F.count("*").over(Window.partitionBy(*key)).alias("n"),
    )
    return rows.withColumnRenamed("of", "key").withColumn("tokens_est", T.even_share("tokens", "n"))


def extract(events: DataFrame, results: DataFrame, roots: DataFrame | None = None, segs: DataFrame | None = None) -> DataFrame:
    """All facts of typed events and their first results, merged and with occupancy; roots (session_id, root) make chain reads relative to their repository."""
    key = ["session_id", *SIDE, "idx", "seq"]
    field = lambda p: F.get_json_object("tool_input", f"$.{p}")
    good = F.when(~F.coalesce("result_error", F.lit(False)), F.col("result_text"))
    calls = events.where("kind = 'tool_use'").join(spread(results), ["session_id", "tool_use_id"], "left").withColumn("out", good)
    calls = calls.withColumn("tokens", F.coalesce(T.token_estimate("out"), F.lit(0))).withColumn("command", F.when(F.col("tool_name") == "Bash", field("command")))
    calls = calls.withColumn("pattern", F.when(F.col("tool_name").isin("Grep", "Glob"), F.nullif(field("pattern"), F.lit(""))))
    said = shell.digest(shell.segments(calls.where("command IS NOT NULL"), segs)).select("command", "items", "ls_only")
    asked = F.array(F.struct(F.lit(0).alias("seg_no"), F.lit(0).alias("probe_no"), F.col("tool_name").alias("label"), "pattern", (F.col("tool_name") == "Glob").alias("glob"), F.lit(None).cast("string").alias("layout"), F.lit("exact").alias("confidence")))
    calls = calls.join(said, "command", "left").withColumn("items", F.when(F.col("pattern").isNotNull(), asked).otherwise(F.col("items")))
    every = looked_for(calls, key)
    first = F.min_by("key", F.when(F.col("kind") == "search", F.col("no")))
    anchor = every.groupBy(*key).agg(F.coalesce(first, F.lit(T.CODE_KEY)).alias("key"), F.first("out").alias("text"), F.bool_or((F.col("kind") == "search") | (F.col("key") == T.CODE_KEY)).alias("any")).where("any").drop("any")
    reads = calls.where("tool_name = 'Read' AND out IS NOT NULL").withColumn("path", field("file_path")).where("path IS NOT NULL")
    stream = anchor.withColumn("op", F.lit("search")).unionByName(reads.select(*key, "path", "cwd", "tokens", F.lit("read").alias("op")), allowMissingColumns=True)
    if roots is not None:
        stream = stream.join(spread(roots.select("session_id", "root")), "session_id", "left")
    runs = windows.runs(calls.withColumn("ls", F.coalesce("ls_only", F.lit(False))), "ls", "NOT ls AND (tool_name <> 'Bash' OR command IS NOT NULL)")
    ritual = runs.select("session_id", *SIDE, "idx", F.lit(0).alias("seq"), F.lit("mapping").alias("kind"), F.lit(T.LAYOUT_KEY).alias("key"), F.lit("ls chain").alias("raw"), F.lit("Bash").alias("tool"), F.col("tokens").alias("tokens_est"), F.lit("heuristic").alias("confidence"))
    last = F.struct(F.lit(1 << 21).alias("seg_no"), F.lit(0).alias("probe_no"), F.lit(0).alias("part_no"))
    facts = every.select(*key, "kind", "key", "raw", "tool", "tokens_est", "confidence", "no")
    joined = facts.unionByName(chain_reads(stream).withColumn("no", last)).unionByName(ritual.withColumn("no", last))
    return windows.occupancy(merged(joined), events)


def tool_output_tokens(events: DataFrame) -> DataFrame:
    """(session_id, tool_output_tokens): all results that carry an id."""
    own = events.where("kind = 'tool_result' AND tool_use_id <> ''")
    return own.groupBy("session_id").agg(F.sum(F.coalesce(T.token_estimate("text"), F.lit(0))).alias("tool_output_tokens"))


def needs(facts: DataFrame, order: list[str]) -> DataFrame:
    """One row per key: what sessions looked for, how often, at what cost, and by which method.

    facts: (session_id, kind, key, raw, tool, tokens_est, occupancy_est, confidence); ``order`` are the columns that say which
    came first. The label is the most frequent spelling, the first seen among equals. Spellings are counted once before they
    meet their key, so a hot key shuffles its spellings and not its facts.
    """
    at = F.struct(*order)
    action = F.col("key").isin(T.LAYOUT_KEY, T.CODE_KEY)
    base = facts.groupBy("key").agg(
        F.countDistinct("session_id").alias("sessions"), F.count("*").alias("times"), F.sum("tokens_est").alias("tokens"), F.sum("occupancy_est").alias("occupancy"),
        F.bool_or(F.col("kind") == "chain_read").alias("chain"), F.bool_or(F.col("confidence") == "heuristic").alias("heuristic"),
    )
    spelled = facts.where("kind <> 'chain_read' AND key <> 'repo layout'").groupBy("key", "raw").agg(F.count("*").alias("n"), F.min(at).alias("first"))
    rank = Window.partitionBy("key").orderBy(F.desc("n"), "first")
    spelled = spelled.withColumn("no", F.row_number().over(rank)).groupBy("key").agg(F.count("*").alias("spellings"), F.max(F.when(F.col("no") == 1, F.col("raw"))).alias("top"), F.array_sort(F.collect_list(F.when(F.col("no") <= 3, F.struct("no", "raw")))).alias("probes"))
    tool = F.when(F.col("kind") == "mapping", F.coalesce(F.regexp_extract("raw", r"^\S+", 0), F.lit(""))).otherwise(F.lower(F.coalesce("tool", F.lit("bash"))))
    heads = facts.where("kind <> 'chain_read' AND key <> 'code structure'").groupBy("key", tool.alias("head")).agg(F.min(at).alias("first"))
    heads = heads.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "head"))), lambda x: x.head), ", ").alias("heads"))
    out = base.join(spelled, "key", "left").join(heads, "key", "left").withColumn("spellings", F.coalesce("spellings", F.lit(0)))
    label = F.when(action, F.col("key")).otherwise(F.coalesce("top", "key"))
    shown = F.array_join(F.transform("probes", lambda x: x.raw), ", ")
    probed = F.concat(F.lit("probes: "), shown, F.when(F.col("spellings") > 3, F.concat(F.lit(" +"), (F.col("spellings") - 3).cast("string"))).otherwise(""), F.when(F.col("chain"), ", opened hits").otherwise(""))
    tried = F.array_join(F.array_compact(F.array(F.nullif("heads", F.lit("")), F.when(F.col("spellings") >= 2, F.format_string("tried %d spellings", "spellings")), F.when(F.col("chain"), F.lit("opened hits")))), ", ")
    method = F.concat(F.when(F.col("key") == T.CODE_KEY, probed).otherwise(tried), F.when(F.col("heuristic"), " ~").otherwise(""))
    return out.select("key", F.when(action, "action").otherwise("keyword").alias("kind"), label.alias("label"), F.trim(method).alias("method"), "sessions", "times", "tokens", "occupancy", "spellings", "chain", "heuristic")


def top_needs(rows: DataFrame, n: int = 10) -> DataFrame:
    return rows.orderBy(F.desc("tokens"), F.desc("times"), "key").limit(n)


def search_counts(facts: DataFrame) -> DataFrame:
    """(key, tool, raw, n) of all searches, for the story behind a key."""
    return facts.where("kind <> 'chain_read'").groupBy("key", F.lower(F.coalesce("tool", F.lit("bash"))).alias("tool"), "raw").agg(F.count("*").alias("n"))


def read_counts(facts: DataFrame) -> DataFrame:
    """(key, file, n) of files opened from results, by base name."""
    return facts.where("kind = 'chain_read'").groupBy("key", F.element_at(F.split("raw", "/"), -1).alias("file")).agg(F.count("*").alias("n"))


def evidence(facts: DataFrame, key: str) -> DataFrame:
    return facts.where(F.col("key") == key).select("session_id", "idx", "kind", "tool", "raw", "tokens_est")


def variants(facts: DataFrame) -> DataFrame:
    """(key, raw, n, spellings): the spellings in which each key was searched, how often each, for keys with two or more."""
    each = facts.where("kind = 'search'").groupBy("key", "raw").agg(F.count("*").alias("n"))
    many = each.groupBy("key").agg(F.count("*").alias("spellings")).where("spellings >= 2")
    return each.join(many, "key").select("key", "raw", "n", "spellings")


def picked(rows: DataFrame, which: str) -> DataFrame:
    """The need of that rank (by cost), key or label."""
    asked = which.strip().lower()
    if asked.isdigit() and int(asked) > 0:
        return rows.orderBy(F.desc("tokens"), F.desc("times"), "key").offset(int(asked) - 1).limit(1)
    return rows.where((F.col("key") == asked) | (F.lower("label") == asked))


def output_share(rows: DataFrame, output: DataFrame) -> DataFrame:
    """Tokens spent on finding things out as a percentage of all tool output, one row (total); null without output."""
    spent = rows.agg(F.sum("tokens").alias("tokens"))
    return spent.join(output.select("total"), how="cross").select("tokens", F.round(F.try_divide(F.col("tokens") * 100.0, F.col("total")), 1).alias("share"))
