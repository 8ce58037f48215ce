"""From transcript files to the archive, and from the archive to reports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.sources import archive, transcripts

from . import attribution, costs, facts, inventory, reports, shell, stale, timeline, windows

#: Versions of what is extracted; an archived session that lacks one of them is ingested again.
VERSIONS = {"facts": 3, "stale": 2, "timeline": 1}
TABLES = ["sessions", "uses", "facts", "stale", "markers", "reads", "timeline", "samples"]
#: Components shown of what is always in context.
SHOWN = 10


@dataclass
class Registry:
    """What sessions are held against: components, repositories (repo_id, root), files (repo_id, path), prices (prefix, in_usd, out_usd)."""

    components: DataFrame
    repos: DataFrame
    files: DataFrame
    prices: DataFrame


def shell_calls(events: DataFrame, results: DataFrame) -> DataFrame:
    """(session_id, idx, command, result_text) of shell commands."""
    calls = events.where("kind = 'tool_use' AND tool_name = 'Bash'").join(results, ["session_id", "tool_use_id"], "left")
    return calls.select("session_id", "idx", F.get_json_object("tool_input", "$.command").alias("command"), "result_text").where("command IS NOT NULL")


def extracted(events: DataFrame, results: DataFrame, health: DataFrame, units: DataFrame, registry: Registry, segs: DataFrame | None = None, keep: Callable[[DataFrame, str], DataFrame] = lambda rows, name: rows) -> dict[str, DataFrame]:
    """The archive's tables from events, their first results and the sessions' health: sessions, uses, facts, stale, markers, reads, timeline, samples.

    Each table is a plan of its own over events and results, so these should be written tables, and ``keep`` writes what several tables have in
    common; segs are the segments of all commands, where they are known.
    """
    owned = keep(transcripts.owned_sessions(health.select("session_id", "cwd"), registry.repos).select("session_id", "repo_id", "root"), "owned")
    reads = keep(timeline.file_reads(events, results, owned, registry.files, registry.components, segs), "reads")
    marks = keep(attribution.attribute(events, results, registry.components, owned, reads), "marks")
    uses = archive.unsure_if_unsupported(attribution.usages(marks), health)
    found = facts.extract(events, results, owned, segs)
    copies = windows.stale_windows(stale.stale_ops(events, results, owned, segs))
    rows = timeline.entries(events, results, registry.components.where("NOT missing"), owned, marks, reads)

    calls = shell_calls(events, results)
    commits = attribution.commit_counts(calls, shell.commits(shell.segments(calls, segs))).select("session_id", "commits")
    said = events.where("kind = 'assistant_msg' AND usage IS NOT NULL").select("session_id", "model", "usage.*")
    priced = costs.session_costs(said, registry.prices, costs.static_basis(registry.components, owned))
    samples = windows.context_samples(events)
    sessions = archive.session_rows(attribution.session_stats(events), health.drop("cwd"), units, priced).join(owned, "session_id", "left")
    sessions = sessions.join(commits, "session_id", "left").join(windows.latest_and_peak(samples), "session_id", "left").withColumn("commits", F.coalesce("commits", F.lit(0)))

    output = facts.tool_output_tokens(events)
    ids = units.select("session_id").join(output, "session_id", "left").withColumn("tool_output_tokens", F.coalesce("tool_output_tokens", F.lit(0)))
    marker = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("version")) for k, v in VERSIONS.items()])).alias("m")
    markers = ids.select("session_id", F.when(F.lit(True), F.col("tool_output_tokens")).alias("tool_output_tokens"), marker).select("session_id", "m.*", "tool_output_tokens")
    loads = archive.unsure_if_unsupported(reads.drop("repo_id", "target", "inside"), health)
    return {"sessions": sessions, "uses": uses, "facts": found, "stale": copies, "markers": markers, "reads": loads, "timeline": rows, "samples": samples}


def ingested(spark: SparkSession, path: str, ingest: int, lines: DataFrame, units: DataFrame, registry: Registry, keep_lines: bool = False) -> DataFrame:
    """Bring whole sessions into the archive as one ingest: units (session_id, modified, size) with their lines. Gives the sessions' health.

    Lines, events, results and newly met commands are written once; all tables are made from these.
    """
    raw = lines
    lines = archive.staged(transcripts.parsed_lines(lines), path, ingest, "lines")
    events = archive.staged(transcripts.events(lines), path, ingest, "events")
    results = archive.staged(transcripts.first_results(events), path, ingest, "results")
    health = archive.staged(transcripts.session_health(lines, events), path, ingest, "health")
    segs = archive.known_commands(spark, path, ingest, shell_calls(events, results).select("command"))
    tables = extracted(events, results, health, units, registry, segs, lambda rows, name: archive.staged(rows, path, ingest, name)) | {"quarantine": archive.quarantined(lines)}
    archive.append(path, ingest, units, tables | ({"lines": raw} if keep_lines else {}))
    return health


def sync(spark: SparkSession, folder: str, path: str, registry: Registry, force: bool = False) -> DataFrame:
    """Ingest what is new, changed or extracted by an older version; one row: new, updated, skipped, degraded, failed."""
    units = transcripts.session_units(transcripts.list_files(spark, folder))
    ingest = archive.next_ingest(spark, path)
    if archive.committed(spark, path) and not force:
        gated = archive.to_ingest(units, archive.current(spark, path, "sessions"), archive.current(spark, path, "markers"), VERSIONS)
    else:
        gated = units.withColumn("reason", F.lit("new"))
    gated = archive.staged(gated, path, ingest, "gated")
    if gated.isEmpty():  # nothing is due, and nothing is committed
        archive.unstage(spark, path, ingest)
        return spark.createDataFrame([(0, 0, units.count(), 0, 0)], "new long, updated long, skipped long, degraded long, failed long")
    lines = transcripts.labelled_lines(transcripts.read_lines(spark, folder), transcripts.read_labels(spark, folder)).join(gated.select("session_id"), "session_id", "left_semi")
    health = ingested(spark, path, ingest, lines, gated.drop("reason"), registry)
    summary = archive.ingest_summary(units, gated, health).collect()  # one row
    archive.unstage(spark, path, ingest)
    return spark.createDataFrame(summary)


def ingest_batch(batch: DataFrame, path: str, registry: Registry, owner: str) -> None:
    """Lines (session_id, stream, file, line_no, raw) of sessions that are still being written, as an ingest like any other.

    What the archive holds of their lines comes before them, so each session is extracted as a whole. A batch that is tried again finds its own number, and
    does nothing if that was committed.
    """
    spark = batch.sparkSession
    ingest = archive.reserve(spark, path, owner)
    done = archive.committed(spark, path)
    if ingest in done or batch.isEmpty():
        return
    key = ["session_id", "file", "line_no"]
    lines = batch.select("session_id", "stream", "file", "line_no", "raw").dropDuplicates(key)
    ids = lines.select("session_id").distinct()
    if done and archive.exists(spark, f"{path}/lines"):
        old = archive.current(spark, path, "lines", ids).alias("o")
        same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key]
        lines = lines.unionByName(old.join(lines.alias("n"), same, "left_anti").select(lines.columns))
    lines = archive.staged(lines, path, ingest, "raw")
    units = lines.groupBy("session_id").agg(F.current_timestamp().alias("modified"), F.sum(F.octet_length("raw") + 1).alias("size"), F.countDistinct(F.coalesce("file", F.lit(""))).alias("files"))
    ingested(spark, path, ingest, lines, archive.staged(units, path, ingest, "units"), registry, keep_lines=True)
    archive.unstage(spark, path, ingest)


def session_report(spark: SparkSession, path: str, registry: Registry, prefix: str) -> dict[str, DataFrame]:
    """The report of the one session whose id starts with ``prefix``.

    Its row, components by state, file loads, timeline with what the main context held, samples of it, bins of loads and actions, needs, stale copies, missed hooks,
    what is always in context, warnings.
    """
    own = reports.by_prefix(archive.current(spark, path, "sessions"), prefix)
    of = lambda name: archive.current(spark, path, name, own)
    uses, copies, samples = of("uses"), of("stale"), of("samples")
    total = sum(F.coalesce(f"{c}_tokens", F.lit(0)) for c in ("input", "output", "cache_creation", "cache_read"))
    bounds = windows.session_bounds(own.select("session_id", "version", total.alias("tokens"), "started_at", "ended_at"))
    rows = timeline.session_timeline(of("timeline"), bounds, copies, samples)
    components = reports.session_components(own, uses, registry.components)
    static = inventory.static_tokens(registry.components.join(own.select("repo_id"), "repo_id", "left_semi"))
    return {
        "session": own, "components": reports.by_state(components), "file_loads": reports.file_loads(of("reads")), "timeline": rows.orderBy("no"), "samples": samples.orderBy("idx"), "bins": timeline.bins(rows, samples),
        "needs": facts.top_needs(facts.needs(of("facts").withColumn("at", F.struct("session_id", "idx")), ["at"])),
        "stale": windows.stale_folded(copies), "stale_copies": windows.stale_numbered(copies), "stale_summary": windows.stale_summary(copies),
        "missed": components.where("miss").select("session_id", "component_id"), "static": static.limit(SHOWN), "static_total": static.agg(F.coalesce(F.sum("static_tokens"), F.lit(0)).alias("static_tokens")),
        "warnings": reports.warnings(own, of("markers").where("name = 'facts'").select("session_id")),
    }


def window_report(spark: SparkSession, path: str, registry: Registry, spec: str, as_of: datetime) -> dict[str, DataFrame]:
    """The report over all sessions since ``spec``: components of each repository, activity by day, costs, needs and their share of tool output, coverage, warnings."""
    start = reports.since(spec, as_of)
    sessions = archive.sessions_since(archive.current(spark, path, "sessions"), start)
    of = lambda name: archive.current(spark, path, name, sessions)
    uses, markers = of("uses"), of("markers")
    missed = attribution.missed_hooks(sessions, uses, registry.components)
    needs = facts.needs(of("facts").withColumn("at", F.struct("session_id", "idx")), ["at"])
    covered = archive.coverage(sessions, markers)
    return {
        "components": reports.by_primary(reports.window_report(sessions, uses, registry.components.where("NOT missing"), missed, start, as_of)),
        "activity": reports.daily_activity(sessions), "costs": reports.cost_totals(sessions), "needs": facts.top_needs(needs), "coverage": covered,
        "share": facts.output_share(needs, covered.select(F.col("tool_output_tokens").alias("total"))), "newest": reports.newest(sessions, 10),
        "warnings": reports.warnings(sessions, markers.where("name = 'facts'").select("session_id")),
    }
