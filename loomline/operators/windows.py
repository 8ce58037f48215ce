"""Analytic windows over events: occupancy, stale copies, runs, numbering, bins.

Events are (session_id, idx, seq, ...). A context window is one of side and agent inside a session; its columns are the
``window`` argument, a list of names. Every ordering is (idx, seq), as several events share a line number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import spread

SIDE = ["is_sidechain", "agent"]
BEFORE = (Window.unboundedPreceding, -1)
SO_FAR = (Window.unboundedPreceding, 0)


def occupancy(facts: DataFrame, events: DataFrame, window: list[str] = SIDE) -> DataFrame:
    """facts with occupancy_est: tokens_est times the assistant turns after idx and before the window's next compaction.

    Null where the window has no assistant turn at all. Marks and facts share one stream, so this is a union and two
    windows over narrow rows, and never a range join.
    """
    key = ["session_id", *window]
    marks = events.where("kind IN ('assistant_msg', 'compaction')").select(*key, "idx", F.when(F.col("kind") == "compaction", 0).otherwise(1).alias("rank"))
    rows = facts.withColumn("rank", F.lit(2)).unionByName(marks, allowMissingColumns=True)
    whole = Window.partitionBy(*key)
    # The compaction of a fact's own line does not cut it off, so it opens the next stretch before the fact.
    rows = rows.withColumn("stretch", F.count_if(F.col("rank") == 0).over(whole.orderBy("idx", "rank").rowsBetween(*SO_FAR)))
    after = Window.partitionBy(*key, "stretch").orderBy("idx").rangeBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("remaining", F.count_if(F.col("rank") == 1).over(after)).withColumn("turns", F.count_if(F.col("rank") == 1).over(whole))
    out = rows.where("rank = 2").withColumn("occupancy_est", F.when(F.col("turns") > 0, F.col("tokens_est") * F.col("remaining")))
    return out.drop("rank", "stretch", "remaining", "turns")


def context_samples(events: DataFrame) -> DataFrame:
    """(session_id, idx, tokens): what the main chain's context held at each answer."""
    tokens = F.col("usage.input") + F.col("usage.cache_read") + F.col("usage.cache_creation")
    return events.where("kind = 'assistant_msg' AND NOT is_sidechain").select("session_id", "idx", tokens.alias("tokens")).where("tokens > 0")


def measured(rows: DataFrame, samples: DataFrame, compactions: DataFrame) -> DataFrame:
    """rows (session_id, idx, is_sidechain, ...) with ``occupancy``: the latest sample at or before idx since the last compaction; null in subagents."""
    mark = lambda df, rank, tokens: df.select("session_id", "idx", F.lit(rank).alias("rank"), tokens.cast("long").alias("sample"))
    stream = rows.withColumn("rank", F.lit(2)).unionByName(mark(compactions, 0, F.lit(None)).unionByName(mark(samples, 1, F.col("tokens"))), allowMissingColumns=True)
    order = Window.partitionBy("session_id").orderBy("idx", "rank").rowsBetween(*SO_FAR)
    stream = stream.withColumn("stretch", F.count_if(F.col("rank") == 0).over(order))
    held = Window.partitionBy("session_id", "stretch").orderBy("idx", "rank").rowsBetween(*SO_FAR)
    stream = stream.withColumn("occupancy", F.when(~F.col("is_sidechain"), F.last("sample", ignorenulls=True).over(held)))
    return stream.where("rank = 2").drop("rank", "sample", "stretch")


def latest_and_peak(samples: DataFrame) -> DataFrame:
    """(session_id, current, peak)."""
    return samples.groupBy("session_id").agg(F.max_by("tokens", "idx").alias("current"), F.max("tokens").alias("peak"))


def runs(calls: DataFrame, joins: str, breaks: str, window: list[str] = SIDE, least: int = 2) -> DataFrame:
    """Runs of rows where ``joins`` holds, cut by rows where ``breaks`` holds; rows of neither kind do neither. (session_id, window, idx, n, tokens) of runs of ``least`` or more."""
    key = ["session_id", *window]
    order = Window.partitionBy(*key).orderBy("idx", "seq").rowsBetween(*SO_FAR)
    island = calls.withColumn("island", F.count_if(F.expr(breaks)).over(order)).where(joins)
    return island.groupBy(*key, "island").agg(F.min("idx").alias("idx"), F.count("*").alias("n"), F.sum("tokens").alias("tokens")).where(F.col("n") >= least).drop("island")


def stale_windows(ops: DataFrame, window: list[str] = SIDE) -> DataFrame:
    """Copies in context that went out of date, and how that ended.

    ops: (session_id, window, idx, seq, op, path, tokens, partial, exact, tool), op being read, mutate or compact; a
    mutation without a path touches all. A copy goes stale at the first mutation of its path after the read, in any
    window of the session. The stale time ends at the window's next read of the path (re-read), at its next
    compaction (compacted), or never. It is exact only if read and mutation are, in one window, of that path by name.

    Mutations join the copies held in the session by (session, path), or by session for those of everything, at most one
    row per copy's key and mutating line. All else is windows over (session, window, path).
    """
    key = ["session_id", *window, "path"]
    own = [F.col(w).alias(f"m_{w}") for w in window]
    reads = ops.where("op = 'read' AND path IS NOT NULL")
    held = reads.select(*key).distinct()
    mutations = ops.where("op = 'mutate'").select("session_id", "idx", "seq", "path", "exact", "tool", *own)
    phase = lambda n: F.lit(n).alias("phase")
    same = F.lit(True)
    for w in window:
        same = same & F.col(w).eqNullSafe(F.col(f"m_{w}"))
    named = held.join(spread(mutations.where("path IS NOT NULL")), ["session_id", "path"]).select(*key, "idx", "seq", phase(1), F.lit("M").alias("op"), "tool", (F.col("exact") & same).alias("exact"))
    wild = mutations.where("path IS NULL").groupBy("session_id", "idx").agg(F.min_by("tool", "seq").alias("tool"), F.min("seq").alias("seq"))
    wild = held.join(spread(wild), "session_id").select(*key, "idx", "seq", phase(2), F.lit("M").alias("op"), "tool", F.lit(False).alias("exact"))
    # A compaction ends what its window holds; it joins only paths that the window has read.
    compact = ops.where("op = 'compact'").select("session_id", *window, "idx", "seq")
    cond = F.col("h.session_id") == F.col("c.session_id")
    for w in window:
        cond = cond & F.col(f"h.{w}").eqNullSafe(F.col(f"c.{w}"))
    compact = held.alias("h").join(spread(compact.alias("c")), cond).select(*[F.col(f"h.{k}") for k in key], "c.idx", "c.seq", phase(0), F.lit("C").alias("op"), F.lit(None).cast("string").alias("tool"), F.lit(True).alias("exact"))
    read = reads.select(*key, "idx", "seq", phase(0), F.lit("R").alias("op"), "tool", "exact", "tokens", "partial")
    stream = read.unionByName(named, allowMissingColumns=True).unionByName(wild, allowMissingColumns=True).unionByName(compact, allowMissingColumns=True)
    order = Window.partitionBy(*key).orderBy("idx", "seq", "phase")
    ahead = order.rowsBetween(1, Window.unboundedFollowing)
    nxt = F.struct("op", "idx", "tool", "exact")
    end = F.when(F.col("op").isin("R", "C"), F.struct("op", "idx"))
    stream = stream.withColumn("next", F.lead(nxt).over(order)).withColumn("end", F.first(end, ignorenulls=True).over(ahead))
    stale = stream.where("op = 'R' AND next.op = 'M'")
    outcome = F.when(F.col("end").isNull(), "never-re-read").when(F.col("end.op") == "R", "re-read").otherwise("compacted")
    sure = F.col("exact") & F.col("next.exact")
    return stale.select(*key, F.col("idx").alias("read_idx"), F.col("next.idx").alias("mutate_idx"), F.col("next.tool").alias("mutate_tool"), F.col("end.idx").alias("close_idx"), outcome.alias("outcome"), F.col("tokens").alias("read_tokens_est"), F.coalesce("partial", F.lit(False)).alias("read_partial"), F.when(sure, "exact").otherwise("heuristic").alias("confidence"))


def stale_numbered(stale: DataFrame) -> DataFrame:
    """Windows with their number in the session, from 1, by (mutation, read, path)."""
    order = Window.partitionBy("session_id").orderBy("mutate_idx", "read_idx", "path")
    return stale.withColumn("stale_no", F.row_number().over(order))


def stale_summary(stale: DataFrame) -> DataFrame:
    """Per session: windows, those never read again, and their tokens."""
    never = F.col("outcome") == "never-re-read"
    return stale.groupBy("session_id").agg(F.count("*").alias("windows"), F.count_if(never).alias("never_re_read"), F.coalesce(F.sum(F.when(never, F.col("read_tokens_est"))), F.lit(0)).alias("never_re_read_tokens"))


def stale_folded(stale: DataFrame, shown: int = 3) -> DataFrame:
    """Windows opened by one mutation with one outcome: how many files, the first names and how many more."""
    out = stale.groupBy("session_id", "mutate_idx", "mutate_tool", "outcome").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    return out.select("session_id", "mutate_idx", "mutate_tool", "outcome", F.size("paths").alias("files"), F.array_join(F.slice("paths", 1, shown), ", ").alias("first_paths"), F.greatest(F.size("paths") - shown, F.lit(0)).alias("more"))


def timeline(sources: list[DataFrame]) -> DataFrame:
    """Rows of all sources, (session_id, idx, seq, ...), numbered from 1 within a session; on ties in order of the sources."""
    rows = None
    for k, source in enumerate(sources):
        source = source.withColumn("source_no", F.lit(k))
        rows = source if rows is None else rows.unionByName(source, allowMissingColumns=True)
    return rows.withColumn("no", F.row_number().over(Window.partitionBy("session_id").orderBy("idx", "seq", "source_no")))


def session_bounds(stats: DataFrame) -> DataFrame:
    """Rows for a timeline at a session's two ends, before and behind all others; stats: (session_id, version, tokens), and times where known."""
    time = lambda c: [F.col(c).alias("ts")] if c in stats.columns else []
    start = stats.select("session_id", F.lit(-1).cast("long").alias("idx"), F.lit(0).alias("seq"), F.lit("session_start").alias("kind"), F.concat(F.lit("version "), F.coalesce("version", F.lit("?"))).alias("detail"), *time("started_at"))
    end = stats.select("session_id", F.lit(10**9).cast("long").alias("idx"), F.lit(0).alias("seq"), F.lit("session_end").alias("kind"), F.format_string("%d tokens", F.coalesce("tokens", F.lit(0))).alias("detail"), *time("ended_at"))
    return start.unionByName(end)


def with_stale_rows(rows: DataFrame, stale: DataFrame) -> DataFrame:
    """A timeline (session_id, no, idx, kind, detail, confidence, ...) with a row for each stale copy behind the mutating line's rows, numbered anew.

    Where a copy is read again, the first row of that line which is a file read or an action says so.
    """
    stale = stale_numbered(stale)
    opened = stale.select(
        "session_id", F.col("mutate_idx").alias("idx"), F.col("stale_no").alias("no"), F.lit("stale_open").alias("kind"), "confidence", F.lit(1).alias("after"),
        F.format_string("S%d %s: copy read at %d, overturned by %s", "stale_no", "path", "read_idx", "mutate_tool").alias("detail"), *[c for c in SIDE if c in stale.columns and c in rows.columns],
    )
    closed = stale.where("outcome = 're-read' AND close_idx IS NOT NULL").groupBy("session_id", F.col("close_idx").alias("idx")).agg(F.array_sort(F.collect_list("stale_no")).alias("closes"))
    first = F.row_number().over(Window.partitionBy("session_id", "idx", "able").orderBy("no"))
    noted = rows.withColumn("able", F.col("kind").isin("file_read", "action")).withColumn("first", F.col("able") & (first == 1)).join(spread(closed), ["session_id", "idx"], "left")
    note = F.array_join(F.transform("closes", lambda n: F.format_string(" (closes S%d)", n)), "")
    noted = noted.withColumn("detail", F.when(F.col("first") & F.col("closes").isNotNull(), F.concat("detail", note)).otherwise(F.col("detail"))).drop("able", "first", "closes")
    every = noted.withColumn("after", F.lit(0)).unionByName(opened, allowMissingColumns=True)
    return every.withColumn("no", F.row_number().over(Window.partitionBy("session_id").orderBy("idx", "after", "no"))).drop("after")


def binned(rows: DataFrame, width: int = 60, by: str = "no", scroll: bool = False) -> DataFrame:
    """(session_id, lane, bin, est, last_no): a session's rows (session_id, lane, no, est) by rank of ``by`` in ``width`` equal bins, each lane summed.

    With ``scroll`` each rank has a bin of its own from the left, and once they fill the width the oldest fall out; the largest sum counts these too.
    """
    order = Window.partitionBy("session_id").orderBy(by)
    ranked = rows.withColumn("rank", F.dense_rank().over(order) - 1).withColumn("n", F.max("rank").over(Window.partitionBy("session_id")) + 1)
    spread = F.least(F.lit(width - 1), F.floor(F.col("rank") * (width - 1) / F.greatest(F.lit(1), F.col("n") - 1)))
    at = F.col("rank") - F.greatest(F.lit(0), F.col("n") - width) if scroll else spread
    out = ranked.withColumn("bin", at.cast("int")).groupBy("session_id", "lane", "bin").agg(F.sum("est").alias("est"), F.max("no").alias("last_no"))
    out = out.withColumn("largest", F.max("est").over(Window.partitionBy("session_id")))
    return out.where("bin >= 0") if scroll else out


def last_marks(bins: DataFrame) -> DataFrame:
    """The newest row of each lane's right-most bin."""
    return bins.groupBy("session_id", "lane").agg(F.max(F.struct("bin", "last_no")).alias("m")).select("session_id", "lane", "m.bin", "m.last_no")


def filled_bins(samples: DataFrame, width: int = 60) -> DataFrame:
    """(session_id, bin, tokens): the largest sample of each bin; an empty bin keeps the one before it."""
    largest = samples.groupBy("session_id", "bin").agg(F.max("tokens").alias("tokens"))
    grid = samples.select("session_id").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    order = Window.partitionBy("session_id").orderBy("bin").rowsBetween(*SO_FAR)
    return grid.join(largest, ["session_id", "bin"], "left").withColumn("tokens", F.last("tokens", ignorenulls=True).over(order))


def turns_backwards(rows: DataFrame, seconds: int = 300) -> DataFrame:
    """(session_id, out_of_order): whether time falls behind what came before by more than ``seconds``."""
    before = F.max("ts").over(Window.partitionBy("session_id").orderBy("idx").rowsBetween(*BEFORE))
    gap = rows.withColumn("before", before).withColumn("gap", F.unix_micros(F.col("before").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")))
    return gap.groupBy("session_id").agg(F.coalesce(F.bool_or(F.col("gap") > seconds * 1_000_000), F.lit(False)).alias("out_of_order"))
