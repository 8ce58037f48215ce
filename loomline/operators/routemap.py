"""The map of a repository's guidance as one report: carriers and how they come into context, structure, dead routes, coverage and what sessions spent.

A carrier is a guidance file, or what guidance imports. The root's guidance is in context from the start, so is what it imports; a
directory's own comes with work in the directory; other documents that lines lead to are read only on demand.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions import text as T

from . import guidance
from .guidance import GUIDE

#: Steps of imports that are followed.
DEPTH = 5
#: How a carrier comes into context; the first and the last are resident.
ROOT, ENTRY, IMPORT = "auto-inject", "dir-entry", "import"


def carriers(index: DataFrame, edges: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(repo_id, node, loading): all guidance files, and what they import within ``depth`` steps; edges: ``guidance.resolved_imports``."""
    guides = index.where((F.col("base") == GUIDE) & ~F.col("is_dir")).select("repo_id", F.col("path").alias("node"))
    held = guidance.import_closure(guides, edges, depth)
    guide = F.col("node").rlike(rf"(^|/){GUIDE}$")
    return held.select("repo_id", "node", F.when(F.col("node") == GUIDE, ROOT).when(guide, ENTRY).otherwise(IMPORT).alias("loading"))


def guidance_map(all_files: DataFrame, facts: DataFrame | None = None, folder: str | None = None) -> dict[str, DataFrame]:
    """The map of every repository of all_files (repo_id, path, text), with the costs of facts (repo_id, kind, key, raw, tokens_est) where given.

    carriers: each with its loading, lines by kind, labels and tokens. totals: a row for each repository. imports_external, imports_beyond, lazy, duplicates,
    dead_routes, hops, unreached, searched: lists by repository. Documents are classified once; all else joins by (repo_id, ...). Tables that several others are made from
    are written to ``folder``, by default a new one in the shared folder.
    """
    folder = folder or f"{guidance.shared_folder(all_files.sparkSession)}/map-{uuid.uuid4().hex}"

    def kept(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/{name}")

    index = kept(guidance.file_index(all_files), "index")
    docs = all_files.where(F.endswith("path", F.lit(".md"))).select("repo_id", F.col("path").alias("carrier"), "text")
    docs = docs.join(index.where("NOT is_dir").select("repo_id", F.col("path").alias("carrier")), ["repo_id", "carrier"], "left_semi")
    lines = kept(guidance.classified_lines(docs), "lines")
    links, external = (kept(rows, name) for rows, name in zip(guidance.resolved_imports(kept(guidance.imports(lines), "imports"), index), ("links", "external"), strict=True))
    audited = kept(carriers(index, links), "carriers")
    beyond = guidance.imports_beyond(index.where((F.col("base") == GUIDE) & ~F.col("is_dir")).select("repo_id", F.col("path").alias("node")), links, DEPTH)
    node = audited.select("repo_id", F.col("node").alias("carrier"), "loading")
    links, external = (rows.join(node, ["repo_id", "carrier"], "left_semi") for rows in (links, external))  # other documents import nothing

    paths = all_files.select("repo_id", "path")
    edges, dead = (kept(rows, name) for rows, name in zip(guidance.references(kept(guidance.candidates(docs), "candidates"), index, paths), ("edges", "dead"), strict=True))
    starts = audited.where((F.col("loading") == IMPORT) | (F.col("node") == GUIDE)).select("repo_id", "node")
    along = edges.select("repo_id", F.col("carrier").alias("source"), "target", F.lit("reference").alias("kind")).distinct()
    reached = guidance.reach(starts, along.unionByName(guidance.listing(index)), guidance.guide_chain(index), f"{folder}/reach")

    own = lines.join(node, ["repo_id", "carrier"], "left_semi")
    # Each line is resolved by itself, so that a target named twice counts twice, however it is spelt.
    found = guidance.candidates(own.where("kind NOT IN ('code', 'blank', 'structural')").withColumn("carrier", F.concat_ws("\u0001", "carrier", "line_no")).select("repo_id", "carrier", "text"))
    per_line, _ = guidance.references(kept(found, "found"), index, paths)
    line = F.substring_index("carrier", "\u0001", -1).cast("int")
    per_line = per_line.select("repo_id", F.substring_index("carrier", "\u0001", 1).alias("carrier"), line.alias("line_no"), "raw", "target").distinct()
    per_line = kept(per_line, "per-line")
    rated = kept(guidance.labelled(guidance.routed(own, per_line), per_line), "rated")
    tokens = docs.join(node, ["repo_id", "carrier"]).select("repo_id", "carrier", "loading", T.token_estimate("text").alias("tokens"))
    rows = tokens.join(guidance.carrier_rollup(rated, ["repo_id", "carrier"]).drop("tokens"), ["repo_id", "carrier"], "left")

    routing = rated.where("kind = 'routing'").select("repo_id", "carrier", "line_no", F.explode("targets").alias("target"))
    stale = guidance.dead_routes(dead, reached, audited, links, external)
    cover = guidance.coverage(index, reached, guidance.symbol_counts(all_files), guidance.search_costs(facts, index) if facts is not None else index.limit(0).select("repo_id", "path", F.lit(0).cast("long").alias("tokens"), F.lit(0).cast("long").alias("searches")))
    resident = rows.groupBy("repo_id").agg(F.sum(F.when(F.col("loading").isin(ROOT, IMPORT), F.col("tokens")).otherwise(0)).alias("resident_tokens"), F.count("*").alias("carriers"))
    joined = facts.select("repo_id").distinct().withColumn("joined", F.lit(True)) if facts is not None else index.limit(0).select("repo_id", F.lit(True).alias("joined"))
    root = index.where(F.col("path") == GUIDE).select("repo_id", F.lit(True).alias("root_present"))
    totals = guidance.file_rollup(index, reached).join(guidance.map_rollup(cover).drop("beyond_three", "deepest"), "repo_id", "left").join(resident, "repo_id", "left").join(root, "repo_id", "left").join(joined, "repo_id", "left")
    totals = totals.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("carriers", "resident_tokens", "code_files", "reached_files", "symbols", "reached_symbols", "unparsed")}).withColumns({c: F.coalesce(c, F.lit(False)) for c in ("root_present", "joined")})
    hops = reached.join(index.where("NOT is_dir").select("repo_id", F.col("path").alias("node")), ["repo_id", "node"], "left_semi")
    return {
        "carriers": rows, "totals": totals, "imports_external": external.select("repo_id", "carrier", "raw").distinct(), "imports_beyond": beyond,
        "lazy": guidance.lazy_references(routing.where("target <> carrier"), audited), "duplicates": guidance.duplicate_routes(routing), "dead_routes": stale.select("repo_id", "carrier", "raw").distinct(),
        "hops": hops.select("repo_id", "node", "hop", "via", "kind"), "unreached": guidance.unreached(cover), "searched": guidance.searched_though_reached(cover),
    }
