"""Guidance documents as a graph over repository files, for many repositories at once.

all_files: (repo_id, path, text), path relative to the repository. Everything joins by (repo_id, ...), so repositories
spread over tasks and never meet.
"""

from __future__ import annotations

import ast
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions import text as T

from .joins import spread

#: Directories left out of the index besides hidden ones, and endings that make a word look like a path.
SKIPPED = [".git", "node_modules", ".venv", "venv", "__pycache__", "dist", "build"]
ENDINGS = [".py", ".md", ".yaml", ".yml", ".toml", ".json", ".sql", ".txt", ".sh", ".cfg", ".ini"]
GUIDE = "CLAUDE.md"
_DIR, _BASE = r"/?[^/]*$", r"^.*/"


def file_index(all_files: DataFrame, kept_dot: str = ".claude") -> DataFrame:
    """(repo_id, path, base, is_dir): files outside skipped and hidden directories, no hidden files, and the directories above them."""
    steps = F.split("path", "/")
    hidden = F.exists(steps, lambda s: s.isin(SKIPPED) | (F.startswith(s, F.lit(".")) & (s != kept_dot)))
    files = all_files.where(~hidden).select("repo_id", "path", F.lit(False).alias("is_dir"))
    dirs = files.select("repo_id", F.explode(T.ancestors("path")).alias("path")).distinct().withColumn("is_dir", F.lit(True))
    return files.unionByName(dirs).withColumn("base", F.regexp_replace("path", _BASE, ""))


def _looks_like_path(c: Column) -> Column:
    ends = F.lit(False)
    for e in ENDINGS:
        ends = ends | F.endswith(c, F.lit(e))
    return ends


def candidates(carriers: DataFrame, text: str = "text") -> DataFrame:
    """carriers exploded to (raw, context, pos): links, inline code, words of prose that look like paths, and what stands in fences."""
    # Fenced blocks, links, inline code; what separates words, and what is cut off their ends.
    fence, link, code = r"(?s)```.*?(?:```|\z)", r"\[[^\]]*\]\(([^)\s]+)\)", r"`([^`\n]+)`"
    words = lambda t: F.filter(
        F.transform(F.split(t, r"[\s,;()|]+"), lambda w: F.regexp_replace(F.regexp_replace(w, r"^[`*\"'<>\[\]]+|[`*\"'<>\[\]]+$", ""), r"/+$|[.,:;!?]+$", "")),
        lambda w: (w != "") & (F.contains(w, F.lit("/")) | _looks_like_path(w)),
    )
    tag = lambda found, kind: F.transform(found, lambda x: F.struct(F.trim(x).alias("raw"), F.lit(kind).alias("context")))
    outside = F.regexp_replace(text, fence, " ")
    inside = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"({fence})"), 1), lambda b: F.regexp_replace(b, r"(?s)^```[^\n]*\n?|```$", "")), "\n")
    prose = F.regexp_replace(F.regexp_replace(outside, link, " "), code, " ")
    found = F.concat(
        tag(F.regexp_extract_all(outside, F.lit(link), 1), "link"), tag(F.regexp_extract_all(outside, F.lit(code), 1), "inline"), tag(words(prose), "prose"),
        tag(F.regexp_extract_all(inside, F.lit(code), 1), "fenced"), tag(words(F.regexp_replace(inside, code, " ")), "fenced"),
    )
    return carriers.select("*", F.posexplode(found).alias("pos", "c")).select("*", "c.raw", "c.context").drop("c", text)


def cleaned(raw: Column | str) -> Column:
    """A candidate without punctuation around it; empty for what is no relative path."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    bare = F.regexp_replace(F.regexp_replace(F.trim(raw), r"^[`\"']+|[`\"']+$", ""), r"[.,:;!?]+$", "")
    return F.regexp_extract(bare, r"^(?!\.\.?$)(?!https?://)([^ ~$/-][^ ]*?)/*$", 1)


def _normal(base: Column, path: Column) -> Column:
    """The path below base, resolved; null if it leaves the repository."""
    whole = F.when(base == "", path).otherwise(F.concat(base, F.lit("/"), path))
    empty = F.expr("cast(array() as array<string>)")
    steps = F.aggregate(
        F.split(whole, "/"), F.struct(empty.alias("s"), F.lit(False).alias("out")),
        lambda a, s: F.when((s == "") | (s == "."), a)
        .when(s == "..", F.struct(F.slice(a.s, 1, F.greatest(F.size(a.s) - 1, F.lit(0))).alias("s"), (a.out | (F.size(a.s) == 0)).alias("out")))
        .otherwise(F.struct(F.concat(a.s, F.array(s)).alias("s"), a.out.alias("out"))),
    )
    return F.when(~steps.out, F.array_join(steps.s, "/"))


def references(found: DataFrame, index: DataFrame, all_files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, dead) of candidates (repo_id, carrier, raw, context, pos).

    A path counts from the carrier's directory, else from the root; a lone file name with one owner in the repository counts as
    a guess. Wild cards match the index. What lies on disk outside the index, and a name with several owners,
    is neither. What was asked and what it hit are written once, as edges and dead references are made from both; found should be a written
    table. edges: (repo_id, carrier, target, is_dir, context, raw, confidence); dead: (repo_id, carrier, raw, context).
    """
    key = ["repo_id", "dir", "clean"]
    rows = found.withColumn("clean", cleaned("raw")).where("clean <> ''").withColumn("dir", F.regexp_replace("carrier", _DIR, ""))
    # What a candidate means depends on its directory and text alone, so each is resolved once.
    asked = rows.select(*key).distinct().withColumn("wild", F.col("clean").rlike(r"[*?\[]")).withColumn("near", _normal(F.col("dir"), F.col("clean"))).withColumn("far", _normal(F.lit(""), F.col("clean")))
    asked = written(asked, "asked")
    here = index.select("repo_id", "path", "is_dir")
    hit = lambda df, target, is_dir, sure: df.select(*key, "rank", target.alias("target"), is_dir.alias("is_dir"), F.lit(sure).alias("confidence"))
    nothing, no = F.lit(None).cast("string"), F.lit(False)
    tries = asked.where("NOT wild").select(*key, F.posexplode(F.array("near", "far")).alias("rank", "path")).where("path IS NOT NULL")
    direct = hit(tries.join(spread(here), ["repo_id", "path"]), F.col("path"), F.col("is_dir"), "exact")
    names = index.where("NOT is_dir").groupBy("repo_id", "base").agg(F.count("*").alias("owners"), F.min("path").alias("owner"))
    lone = ~F.contains("clean", F.lit("/")) & _looks_like_path(F.col("clean"))
    named = asked.where(~F.col("wild") & lone).withColumn("base", F.col("clean")).withColumn("rank", F.lit(2)).join(spread(names), ["repo_id", "base"])
    named = hit(named, F.when(F.col("owners") == 1, F.col("owner")), no, "heuristic")
    disk = all_files.select("repo_id", "path").unionByName(all_files.select("repo_id", F.explode(T.ancestors("path")).alias("path"))).distinct()
    excluded = hit(tries.withColumn("rank", F.lit(3)).join(spread(disk), ["repo_id", "path"]), nothing, no, "exact")
    # A wild card meets only files with its own literal beginning's first directory, or all of its repository without one.
    pattern = lambda p: F.concat(F.lit("^"), F.replace(F.replace(F.replace(F.regexp_replace(p, r"([.+^$(){}|\\])", r"\\$1"), F.lit("**/"), F.lit("\u0001")), F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]")), F.lit("$"))
    globs = asked.where("wild").select(*key, F.posexplode(F.array("near", "far")).alias("rank", "glob")).where("glob IS NOT NULL")
    globs = globs.withColumn("re", F.replace(pattern(F.col("glob")), F.lit("\u0001"), F.lit("(?:.*/)?")))
    fixed = F.substring_index("glob", "/", 1)
    globs = globs.withColumn("top", F.when(F.contains("glob", F.lit("/")) & ~fixed.rlike(r"[*?\[]"), fixed).otherwise(""))
    tops = here.withColumn("top", F.explode(F.array_distinct(F.array(F.lit(""), F.substring_index("path", "/", 1)))))
    matched = hit(globs.join(spread(tops), ["repo_id", "top"]).where(F.rlike("path", F.col("re"))), F.col("path"), F.col("is_dir"), "exact")
    hits = direct.unionByName(named).unionByName(excluded).unionByName(matched)
    hits = hits.withColumn("best", F.min("rank").over(Window.partitionBy(*key))).where("rank = best").drop("rank", "best").distinct()
    hits = written(hits, "hits")
    edges = rows.join(spread(hits.where("target IS NOT NULL")), key)
    edges = edges.groupBy("repo_id", "carrier", "target", "context").agg(F.min_by(F.struct("raw", "confidence", "is_dir"), "pos").alias("e")).select("repo_id", "carrier", "target", "context", "e.*")
    missed = asked.where(~F.contains("clean", F.lit("<")) & ~F.contains("clean", F.lit(">"))).select(*key).join(spread(hits.select(*key).distinct()), key, "left_anti")
    start = F.substring_index("clean", "/", 1)
    first = missed.select(*key, F.explode(F.array_distinct(F.array_compact(F.array(_normal(F.col("dir"), start), start)))).alias("path"))
    rooted = first.join(spread(here), ["repo_id", "path"], "left_semi").select(*key).distinct().withColumn("rooted", F.lit(True))
    dead = missed.join(spread(rooted), key, "left").where(_looks_like_path(F.col("clean")) | (F.contains("clean", F.lit("/")) & F.col("rooted")))
    return edges, rows.join(spread(dead.select(*key)), key).select("repo_id", "carrier", F.col("clean").alias("raw"), "context").distinct()


def reach(starts: DataFrame, edges: DataFrame, free: DataFrame | None = None, folder: str | None = None, most: int | None = None) -> DataFrame:
    """(repo_id, node, hop, via, kind): what can be reached from starts (repo_id, node), by least hops; all of it, or what lies within ``most`` hops if given.

    edges (repo_id, source, target, kind) cost a hop; ``free`` ones (repo_id, source, target) cost none and are followed within a
    hop. Each round joins only the newest nodes and is written to the shared folder, so lineage and work stay with the frontier.
    """
    spark = starts.sparkSession
    folder = folder or f"{shared_folder(spark)}/reach-{uuid.uuid4().hex}"
    schema = "repo_id string, node string, hop int, via string, kind string"
    key = ["repo_id", "node"]
    typed = lambda df: df.select(F.col("repo_id").cast("string"), F.col("node").cast("string"), F.col("hop").cast("int"), F.col("via").cast("string"), F.col("kind").cast("string"))
    rank = F.when(F.col("kind") == "start", 0).when(F.col("kind") == "chain", 1).when(F.col("kind") == "reference", 2).otherwise(3)
    once = Window.partitionBy(*key).orderBy(rank, "via")
    best = lambda df: df.withColumn("no", F.row_number().over(once)).where("no = 1").drop("no")
    frontier = typed(starts.select("repo_id", "node", F.lit(0).alias("hop"), F.lit(None).alias("via"), F.lit("start").alias("kind")).distinct())
    step, hop = 0, 0
    while True:
        frontier.write.parquet(f"{folder}/step={step}")
        frontier = spark.read.schema(schema).parquet(f"{folder}/step={step}")
        seen = spark.read.schema(schema).option("basePath", folder).parquet(folder).select(*schema_names(schema))
        new = None
        if free is not None:
            new = frontier.join(spread(free.withColumnRenamed("source", "node")), key).select("repo_id", F.col("target").alias("node"), "hop", F.col("node").alias("via"), F.lit("chain").alias("kind"))
            new = typed(best(new.join(spread(seen), key, "left_anti")))
        if new is None or new.isEmpty():
            hop += 1
            newest = seen.where(F.col("hop") == hop - 1)
            new = newest.join(spread(edges.withColumnRenamed("source", "node").withColumnRenamed("kind", "how")), key).select("repo_id", F.col("target").alias("node"), F.lit(hop).alias("hop"), F.col("node").alias("via"), F.col("how").alias("kind"))
            new = typed(best(new.join(spread(seen), key, "left_anti")))
            if (most is not None and hop > most) or new.isEmpty():
                return seen
        frontier, step = new, step + 1


def schema_names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(",")]


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; a local master may do without."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    import tempfile

    spark.conf.set("spark.checkpoint.dir", found := "file://" + tempfile.mkdtemp(prefix="spark-"))
    return found


def written(rows: DataFrame, label: str) -> DataFrame:
    """rows as a table in the shared folder, read again: what several plans are made from is made once, and plans stay short."""
    path = f"{shared_folder(rows.sparkSession)}/loomline/{label}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def guide_chain(index: DataFrame, guide: str = GUIDE) -> DataFrame:
    """Free edges (repo_id, source, target): each node leads to the guidance files of the directories it lies in."""
    files = index.where((F.col("base") == guide) & ~F.col("is_dir")).select("repo_id", F.col("path").alias("target"), F.regexp_replace("path", _DIR, "").alias("dir"))
    above = F.concat(F.array(F.lit("")), T.ancestors("path"), F.when(F.col("is_dir"), F.array("path")).otherwise(F.expr("cast(array() as array<string>)")))
    return index.select("repo_id", F.col("path").alias("source"), F.explode(above).alias("dir")).join(spread(files), ["repo_id", "dir"]).where("source <> target").select("repo_id", "source", "target")


def listing(index: DataFrame) -> DataFrame:
    """Edges from each directory to the files directly in it."""
    own = index.where("NOT is_dir AND path LIKE '%/%'")
    return own.select("repo_id", F.regexp_replace("path", _DIR, "").alias("source"), F.col("path").alias("target"), F.lit("ls").alias("kind"))


def imports(lines: DataFrame) -> DataFrame:
    """(repo_id, carrier, raw, target, far): what lines that are no code import, and where it would lie, from the carrier's directory and from the root; null outside the repository."""
    # Fixed value: the pattern.
    words = F.regexp_extract_all("text", F.lit(r"(?<!\S)@([A-Za-z0-9_~][A-Za-z0-9_./-]*)"), 1)
    own = lines.where("kind <> 'code'").select("repo_id", "carrier", F.explode(words).alias("raw")).distinct()
    own = own.where(F.contains("raw", F.lit("/")) | F.startswith("raw", F.lit("~")) | _looks_like_path(F.col("raw")))
    inside = ~F.startswith("raw", F.lit("~"))
    return own.withColumn("target", F.when(inside, _normal(F.regexp_replace("carrier", _DIR, ""), F.col("raw")))).withColumn("far", F.when(inside, _normal(F.lit(""), F.col("raw"))))


def resolved_imports(links: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, external) of imports: those whose target, else whose place from the root, is a file of the repository, and the others."""
    files = index.where("NOT is_dir").select("repo_id", F.col("path").alias("held"))
    tries = F.array_compact(F.array(*[c for c in ("target", "far") if c in links.columns]))
    rows = links.withColumn("word", F.col("raw") if "raw" in links.columns else F.col("target"))
    hit = rows.select("repo_id", "carrier", "word", F.posexplode(tries).alias("rank", "held")).join(files, ["repo_id", "held"])
    hit = hit.groupBy("repo_id", "carrier", "word").agg(F.min_by("held", "rank").alias("held"))
    edges = hit.select("repo_id", "carrier", F.col("held").alias("target")).distinct()
    return edges, rows.join(hit.drop("held"), ["repo_id", "carrier", "word"], "left_anti").drop("word")


def imports_beyond(starts: DataFrame, edges: DataFrame, depth: int = 5) -> DataFrame:
    """(repo_id, node) that imports name one step beyond ``depth``, and that therefore stay out."""
    held = import_closure(starts, edges, depth)
    last = held.where(F.col("hop") == depth).select("repo_id", F.col("node").alias("carrier"))
    beyond = edges.join(last, ["repo_id", "carrier"]).select("repo_id", F.col("target").alias("node")).distinct()
    return beyond.join(held.select("repo_id", "node"), ["repo_id", "node"], "left_anti")


def import_closure(starts: DataFrame, edges: DataFrame, depth: int = 5) -> DataFrame:
    """What imports lead to within ``depth`` steps."""
    return reach(starts, edges.select("repo_id", F.col("carrier").alias("source"), "target", F.lit("reference").alias("kind")), most=depth)


def classified_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs (..., text) as lines (line_no from 1, text, kind): code, blank, structural, heading or prose; routing needs references and comes from ``routed``.

    Fence lines in pairs enclose code, the last one to the end. Marks for all lines are laid out stretch by stretch, so the work is linear in a document's lines.
    """
    lines = F.split(F.regexp_replace(text, r"(\r\n|\r|\n)\z", ""), "\r\n|\r|\n")
    fence = lambda line: F.startswith(F.trim(line), F.lit("```"))
    rows = docs.withColumn("__lines", lines).withColumn("__at", F.array_compact(F.transform("__lines", lambda line, k: F.when(fence(line), k))))
    n, pairs = F.size("__lines"), F.ceil(F.size("__at") / 2).cast("int")
    begin = lambda k: F.get("__at", 2 * k)
    end = lambda k: F.coalesce(F.get("__at", 2 * k + 1), n - 1)
    stretch = lambda k: F.concat(F.array_repeat(F.lit(False), begin(k) - F.when(k > 0, end(k - 1)).otherwise(-1) - 1), F.array_repeat(F.lit(True), end(k) - begin(k) + 1))
    code = F.when(pairs > 0, F.concat(F.flatten(F.transform(F.sequence(F.lit(0), pairs - 1), stretch)), F.array_repeat(F.lit(False), n - 1 - end(pairs - 1)))).otherwise(F.array_repeat(F.lit(False), n))
    rows = rows.select("*", F.posexplode(F.arrays_zip(F.col("__lines").alias("line"), code.alias("code"))).alias("at", "l")).drop(text, "__lines", "__at")
    line, bare = F.col("l.line"), F.trim(F.col("l.line"))
    kind = F.when(F.col("l.code"), "code").when(T.strip(line) == "", "blank").when(~bare.rlike(r"[^|\-:=+ ]"), "structural").when(F.startswith(bare, F.lit("#")), "heading").otherwise("prose")
    return rows.withColumn("line_no", F.col("at") + 1).withColumn("kind", kind).withColumn("text", line).drop("l", "at")


def routed(lines: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines with the files they lead to: headings and prose with any become routing. edges: (repo_id, carrier, line_no, target)."""
    targets = edges.groupBy("repo_id", "carrier", "line_no").agg(F.array_sort(F.collect_set("target")).alias("targets"))
    out = lines.join(targets, ["repo_id", "carrier", "line_no"], "left")
    return out.withColumn("kind", F.when(F.col("kind").isin("heading", "prose") & F.col("targets").isNotNull(), "routing").otherwise(F.col("kind")))


def label_quality(text: Column, raws: Column, targets: Column) -> Column:
    """bare: nothing but the reference; echo: only words of its path; else said."""
    rest = F.aggregate(raws, text, lambda a, r: F.replace(a, r, F.lit(" ")))
    words = F.filter(F.split(F.lower(rest), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    known = F.flatten(F.transform(targets, lambda t: F.split(F.lower(t), r"[^\p{L}\p{N}]+|_")))
    return F.when(F.size(words) == 0, "bare").when(F.size(F.array_except(words, known)) == 0, "echo").otherwise("said")


def carrier_rollup(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Per document: lines of each kind, the share of prose, prose before the first routing line, tokens; with a column ``label``, routing lines that are bare or echo their path."""
    is_ = lambda k: F.col("kind") == k
    first = F.min(F.when(is_("routing"), F.col("line_no"))).over(Window.partitionBy(*keys))
    rows = lines.withColumn("first", first)
    named = [F.count_if(is_("routing") & (F.col("label") == k)).alias(k) for k in ("bare", "echo")] if "label" in lines.columns else []
    said = F.count_if(F.col("kind").isin("routing", "prose", "heading"))
    return rows.groupBy(*keys).agg(
        *[F.count_if(is_(k)).alias(k) for k in ("routing", "prose", "heading", "structural", "code", "blank")], F.round(F.try_divide(F.count_if(is_("prose")), said), 4).alias("prose_share"),
        F.count_if(is_("prose") & (F.col("first").isNull() | (F.col("line_no") < F.col("first")))).alias("prose_before_routing"), F.sum(T.token_estimate("text")).alias("tokens"), *named,
    )


def labelled(lines: DataFrame, found: DataFrame) -> DataFrame:
    """Routed lines with the quality of their label; found: (repo_id, carrier, line_no, raw, target)."""
    refs = found.groupBy("repo_id", "carrier", "line_no").agg(F.collect_set("raw").alias("raws"), F.collect_set("target").alias("hit"))
    out = lines.join(refs, ["repo_id", "carrier", "line_no"], "left")
    return out.withColumn("label", F.when(F.col("kind") == "routing", label_quality(F.col("text"), F.col("raws"), F.col("hit")))).drop("raws", "hit")


def duplicate_routes(edges: DataFrame) -> DataFrame:
    """Targets that one carrier leads to from several lines."""
    return edges.where("target <> carrier").groupBy("repo_id", "carrier", "target").agg(F.countDistinct("line_no").alias("lines")).where("lines > 1")


def dead_routes(dead: DataFrame, reached: DataFrame, audited: DataFrame, imported: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """Dead references of carriers that are reached or audited, without those that are imports.

    A reference that begins with @ is one if what follows, from its carrier's directory or from the root, is what any import of the repository leads to, or if
    the same word stands among the external imports. Both are joins by equality.
    """
    of = lambda df: dead.join(df.select("repo_id", F.col("node").alias("carrier")), ["repo_id", "carrier"], "left_semi")
    both = of(reached).unionByName(of(audited)).distinct()
    word = both.where(F.startswith("raw", F.lit("@"))).select("repo_id", "carrier", "raw").distinct().withColumn("bare", F.substr("raw", F.lit(2)))
    places = F.array_distinct(F.array_compact(F.array(_normal(F.regexp_replace("carrier", _DIR, ""), F.col("bare")), _normal(F.lit(""), F.col("bare")))))
    known = word.select("repo_id", "carrier", "raw", F.explode(places).alias("target")).join(imported.select("repo_id", "target"), ["repo_id", "target"], "left_semi").drop("target")
    if external is not None:
        known = known.unionByName(word.join(external.select("repo_id", F.concat(F.lit("@"), "raw").alias("raw")), ["repo_id", "raw"], "left_semi").select("repo_id", "carrier", "raw"))
    return both.join(known, ["repo_id", "carrier", "raw"], "left_anti")


def lazy_references(edges: DataFrame, audited: DataFrame, guide: str = GUIDE) -> DataFrame:
    own = edges.where(F.endswith("target", F.lit(".md")) & ~F.col("target").rlike(rf"(^|/){guide}$")).select("repo_id", F.col("target").alias("node")).distinct()
    return own.join(audited.select("repo_id", "node"), ["repo_id", "node"], "left_anti")


def _symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def count(text: str) -> int | None:
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return None
        return sum(isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) for n in ast.walk(tree))

    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("repo_id"), batch.column("path"), pa.array([None if t is None else count(t) for t in batch.column("text").to_pylist()], pa.int64())], ["repo_id", "path", "defs"])


def symbol_counts(all_files: DataFrame) -> DataFrame:
    """(repo_id, path, defs) of code files; null where the source does not parse."""
    return all_files.where(F.endswith("path", F.lit(".py"))).select(F.col("repo_id").cast("string").alias("repo_id"), "path", "text").mapInArrow(_symbols, "repo_id string, path string, defs long")


def coverage(index: DataFrame, reached: DataFrame, symbols: DataFrame, costs: DataFrame) -> DataFrame:
    """Code files with their symbols, what sessions spent to find them, and whether guidance leads to them."""
    seen = reached.select("repo_id", F.col("node").alias("path"), "hop")
    out = index.where("NOT is_dir").join(spread(symbols), ["repo_id", "path"]).join(spread(costs), ["repo_id", "path"], "left").join(spread(seen), ["repo_id", "path"], "left")
    return out.select("repo_id", "path", "defs", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("searches", F.lit(0)).alias("searches"), "hop", F.col("hop").isNotNull().alias("reachable"))


def map_rollup(cover: DataFrame) -> DataFrame:
    """Per repository: code files and symbols, reached ones, failures to parse, files beyond three hops."""
    r = F.col("reachable")
    return cover.groupBy("repo_id").agg(
        F.count("*").alias("code_files"), F.count_if(r).alias("reached_files"), F.coalesce(F.sum("defs"), F.lit(0)).alias("symbols"), F.coalesce(F.sum(F.when(r, F.col("defs"))), F.lit(0)).alias("reached_symbols"),
        F.count_if(F.col("defs").isNull()).alias("unparsed"), F.count_if(F.col("hop") > 3).alias("beyond_three"), F.max("hop").alias("deepest"),
    )


def file_rollup(index: DataFrame, reached: DataFrame) -> DataFrame:
    """Per repository: all files, those that guidance leads to, how many at each hop, the deepest, and those beyond three."""
    hops = index.where("NOT is_dir").select("repo_id", "path").join(spread(reached.select("repo_id", F.col("node").alias("path"), "hop")), ["repo_id", "path"], "left")
    at = hops.groupBy("repo_id", "hop").agg(F.count("*").alias("n"))
    each = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("hop").isNotNull(), F.struct("hop", "n")))))
    return at.groupBy("repo_id").agg(
        F.sum("n").alias("files"), F.coalesce(F.sum(F.when(F.col("hop").isNotNull(), F.col("n"))), F.lit(0)).alias("reached"), each.alias("hops"),
        F.max("hop").alias("deepest"), F.coalesce(F.sum(F.when(F.col("hop") > 3, F.col("n"))), F.lit(0)).alias("beyond_three"),
    )


def unreached(cover: DataFrame) -> DataFrame:
    """Code files that guidance does not lead to, the costliest to find first."""
    return cover.where("NOT reachable").orderBy(F.desc("tokens"), F.desc("searches"), F.desc(F.coalesce("defs", F.lit(0))), "path")


def searched_though_reached(cover: DataFrame) -> DataFrame:
    """Code files that sessions searched for although guidance leads to them."""
    return cover.where("reachable AND searches > 0").orderBy(F.desc("tokens"), "path")


def search_costs(facts: DataFrame, index: DataFrame) -> DataFrame:
    """(repo_id, path, tokens, searches): a file opened from a search takes on that key's searches and their tokens."""
    opened = facts.where("kind = 'chain_read'").select("repo_id", "key", F.col("raw").alias("path")).distinct()
    spent = facts.where("kind = 'search'").groupBy("repo_id", "key").agg(F.sum("tokens_est").alias("tokens"), F.count("*").alias("n"))
    out = opened.join(spread(spent), ["repo_id", "key"], "left").join(spread(index.where("NOT is_dir").select("repo_id", "path")), ["repo_id", "path"], "left_semi")
    return out.groupBy("repo_id", "path").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.sum(F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))).alias("searches"))


def skeleton(index: DataFrame, most: int = 300) -> DataFrame:
    """(repo_id, text): all files of a small repository, or the counts of a large one's top directories."""
    files = index.where("NOT is_dir")
    n = files.groupBy("repo_id").agg(F.count("*").alias("n"))
    files = files.join(n, "repo_id")
    flat = files.where(F.col("n") <= most).groupBy("repo_id").agg(F.array_join(F.array_sort(F.collect_list("path")), "\n").alias("text"))
    top = F.when(F.contains("path", F.lit("/")), F.concat(F.substring_index("path", "/", 1), F.lit("/"))).otherwise(F.col("path"))
    tops = files.where(F.col("n") > most).groupBy("repo_id", top.alias("top")).agg(F.count("*").alias("m"))
    grouped = tops.groupBy("repo_id").agg(F.array_join(F.array_sort(F.collect_list(F.format_string("%s (%d)", "top", "m"))), "\n").alias("text"))
    return flat.unionByName(grouped)
