"""Rollups over the archive: components in a window of time, activity by day, costs, file loads."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import text as T

from .joins import dealt, met, spread, tasks_for

LOW_USE = 2


def since(spec: str, as_of: datetime) -> datetime:
    """The start of a window: "30d", "12w", or an ISO date or time; without offset it is UTC."""
    if spec[-1:] in ("d", "w") and spec[:-1].isdigit():
        return as_of - timedelta(days=int(spec[:-1]) * (7 if spec[-1] == "w" else 1))
    at = datetime.fromisoformat(spec)
    return at.astimezone(UTC) if at.tzinfo else at.replace(tzinfo=UTC)


def scope(*tables: DataFrame) -> list[str]:
    """repo_id where all tables have it: components of one id in several repositories are then told apart."""
    return ["repo_id"] if all("repo_id" in t.columns for t in tables) else []


def window_usage(uses: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per component, and repository where sessions have one: invocations, loads, whether any is heuristic, and when it was last used."""
    key = scope(sessions)
    joined = uses.join(spread(sessions.select("session_id", "started_at", *key)), "session_id")
    of = lambda state: F.sum(F.when(F.col("state") == state, F.col("count")).otherwise(0))
    used = F.col("state").isin("invoked", "loaded") & (F.col("count") > 0)
    return joined.groupBy(*key, "component_id").agg(of("invoked").alias("invoked"), of("loaded").alias("loaded"), F.max("confidence").alias("confidence"), F.max(F.when(used, F.col("started_at"))).alias("last_used"))


def status(any_session: Column, as_of: Column, window_days: Column | float, low: int = LOW_USE) -> Column:
    """The status of a component row (type, states, invoked, loaded, last_used, missed)."""
    has = lambda s: F.array_contains("states", s)
    primary = F.when(has("invoked"), F.col("invoked")).otherwise(F.col("loaded"))
    used = F.col("invoked") + F.col("loaded") > 0
    days = F.lit(window_days) if not isinstance(window_days, Column) else window_days
    stale = F.coalesce((F.unix_timestamp(as_of) - F.unix_timestamp("last_used")) / 86400 > days * 2 / 3, F.lit(False))
    little = (primary <= low) | stale
    hook = F.when(F.col("invoked") == 0, "never triggered").otherwise(F.concat(F.when(little, "low-use").otherwise("active"), F.when(F.col("missed") > 0, F.format_string(" (%d MISS)", "missed")).otherwise("")))
    other = F.when(~used & (has("loaded") | has("invoked")), "unused").when(little, "low-use").otherwise("active")
    out = F.when(~any_session, "no data").when(F.col("type") == "hook", hook).otherwise(other)
    return F.concat(out, F.when(~has("invoked") & used & (out != "never triggered"), " (loaded)").otherwise(""))


def window_report(sessions: DataFrame, uses: DataFrame, components: DataFrame, missed: DataFrame, start: datetime, as_of: datetime, low: int = LOW_USE) -> DataFrame:
    """Every component with its use since ``start`` and its status; the window filter reaches the scan of sessions.

    Where sessions and components name their repository, a component's row counts the sessions of its own repository only; missed has the same key.
    """
    key = scope(sessions, components)
    own = sessions.where(F.col("started_at") >= F.lit(start))
    rolled = window_usage(uses, own if key else own.drop("repo_id"))
    rows = components.select(*key, F.col("id").alias("component_id"), "type", "states").join(rolled, [*key, "component_id"], "left").join(missed.select(*key, "component_id", "missed"), [*key, "component_id"], "left")
    if key:
        rows = rows.join(own.select(*key).distinct().withColumn("any_session", F.lit(True)), key, "left").withColumn("any_session", F.coalesce("any_session", F.lit(False)))
    else:
        rows = rows.join(own.agg((F.count("*") > 0).alias("any_session")), how="cross")  # one row
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("invoked", "loaded", "missed")})
    days = (as_of - start).total_seconds() / 86400
    primary = F.when(F.array_contains("states", "invoked"), F.col("invoked")).otherwise(F.col("loaded"))
    return rows.select(*key, "component_id", "type", "invoked", "loaded", primary.alias("primary_count"), "last_used", "missed", "confidence", status(F.col("any_session"), F.lit(as_of), days, low).alias("status"))


def session_components(sessions: DataFrame, uses: DataFrame, components: DataFrame) -> DataFrame:
    """Every present component of a session's repository with its best state, registered at least, its counts, confidence, and whether a commit missed it.

    sessions: (session_id, repo_id, version, commits). For reports on few sessions.
    """
    count = lambda state: F.coalesce(F.sum(F.when(F.col("state") == state, F.col("count"))), F.lit(0)).alias(state)
    due = F.col("miss_when") == "git_commit" if "miss_when" in components.columns else F.lit(False)
    every = components.where("NOT missing").select("repo_id", F.col("id").alias("component_id"), "type", "states", due.alias("due"))
    rows = sessions.select("session_id", "repo_id", "commits", T.supported_version("version").alias("known")).join(every, "repo_id")
    key, tasks = ["session_id", "component_id"], tasks_for(rows)
    seen = dealt(uses, tasks, *key).groupBy(*key).agg(count("invoked"), count("loaded"), F.max("confidence").alias("confidence"))
    rows = met(rows, seen, key, tasks, "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("invoked", "loaded")})
    state = F.when(F.col("invoked") > 0, "invoked").when(F.col("loaded") > 0, "loaded").otherwise("registered")
    able = F.when(F.array_contains("states", "invoked"), "invoked").when(F.array_contains("states", "loaded"), "loaded").otherwise("registered")
    miss = F.coalesce((F.col("type") == "hook") & F.col("due") & (F.col("commits") > 0) & (F.col("invoked") == 0), F.lit(False))
    sure = F.when(F.col("known"), F.coalesce("confidence", F.lit("exact"))).otherwise("heuristic")
    return rows.select("session_id", "repo_id", "component_id", "type", state.alias("state"), "invoked", "loaded", sure.alias("confidence"), miss.alias("miss"), able.alias("most"))


def best_states(uses: DataFrame, components: DataFrame) -> DataFrame:
    """(session_id, component_id, state): the highest state with a count."""
    rank = F.when(F.col("state") == "invoked", 2).when(F.col("state") == "loaded", 1).otherwise(0)
    return uses.where("count > 0").join(components.select(F.col("id").alias("component_id")), "component_id", "left_semi").groupBy("session_id", "component_id").agg(F.max_by("state", rank).alias("state"))


def daily_activity(sessions: DataFrame, filled_to: int = 40) -> DataFrame:
    """(day, sessions); days without any appear too if all lie within ``filled_to`` days."""
    days = sessions.where("started_at IS NOT NULL").groupBy(F.to_date("started_at").alias("day")).agg(F.count("*").alias("sessions"))
    ends = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).where(F.datediff("b", "a") <= filled_to)
    every = ends.select(F.explode(F.sequence("a", "b")).alias("day"))
    return days.unionByName(every.join(days, "day", "left_anti").select("day", F.lit(0).cast("long").alias("sessions")))


def cost_totals(sessions: DataFrame) -> DataFrame:
    """Cost and static cost of all sessions; null where none is known."""
    return sessions.agg(F.round(F.sum("cost_usd"), 4).alias("cost_usd"), F.round(F.sum("static_usd"), 4).alias("static_usd"), F.count_if(F.col("cost_usd").isNull()).alias("unpriced_sessions"))


def file_loads(reads: DataFrame) -> DataFrame:
    """Per (session, path): order of first load, loads in all and by tool, confidence, ranges read. What subagents read is in their context, not in this one, and is left out."""
    if "is_sidechain" in reads.columns:
        reads = reads.where("NOT is_sidechain")
    tools = reads.groupBy("session_id", "path", "tool").agg(F.count("*").alias("n")).groupBy("session_id", "path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", "n")))).alias("by_tool"))
    out = reads.groupBy("session_id", "path").agg(F.min(F.struct("idx", "seq")).alias("first"), F.count("*").alias("loads"), F.max("confidence").alias("confidence"), F.array_sort(F.collect_list(F.when(F.col("range").isNotNull(), F.struct("idx", "seq", "range")))).alias("ranges"))
    order = Window.partitionBy("session_id").orderBy("first", "path")
    return out.join(spread(tools), ["session_id", "path"]).withColumn("no", F.row_number().over(order)).select("session_id", "path", "no", F.col("first.idx").alias("first_idx"), "loads", "by_tool", "confidence", F.transform("ranges", lambda r: r.range).alias("ranges"))


def warnings(sessions: DataFrame, covered: DataFrame) -> DataFrame:
    """(code, n): degraded sessions, sessions without events, unpriced ones, those without extracted facts."""
    gap = sessions.join(covered, "session_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("facts missing").alias("code"), "n")
    counts = sessions.agg(F.count_if(F.col("parse_status") == "degraded").alias("degraded"), F.count_if(F.col("turns") == 0).alias("no data"), F.count_if(F.size("unpriced") > 0).alias("unpriced"))
    return counts.unpivot([], ["degraded", "no data", "unpriced"], "code", "n").unionByName(gap).where("n > 0")


def by_state(rows: DataFrame) -> DataFrame:
    rank = F.when(F.col("state") == "invoked", 2).when(F.col("state") == "loaded", 1).otherwise(0)
    return rows.orderBy(F.desc(rank), "component_id")


def by_primary(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("primary_count"), "component_id", *scope(rows))


def newest(sessions: DataFrame, n: int) -> DataFrame:
    return sessions.orderBy(F.desc("started_at"), "session_id").limit(n)


def by_prefix(sessions: DataFrame, prefix: str) -> DataFrame:
    """The one session whose id starts so; an error for none or several."""
    found = sessions.where(F.startswith("session_id", F.lit(prefix)))
    n = found.limit(2).count()
    if n != 1:
        raise LookupError(f"{'no' if n == 0 else 'more than one'} session starts with {prefix!r}")
    return found
