"""Shell commands as segments, and what segments read, search and change.

Splitting a command into words needs a tokenizer, so distinct commands pass once through an Arrow function that returns
(command, seg_no, sep, argv). Everything after that is relational.
"""

from __future__ import annotations

import shlex
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import text as T

#: Characters that part segments, and characters that no plain path holds.
SEPARATORS, META = set("|&;\n"), r"[<>|&$(){}`*?]"
#: Flags of git that take the next word.
GIT_VALUE_FLAGS = ["-C", "-c", "--git-dir", "--work-tree", "--namespace"]
#: Flags of grep that take the next word, those of rg besides, and those that give the pattern.
GREP_VALUE_FLAGS = [
    "-A", "-B", "-C", "-m", "-e", "-f", "-d", "-D",
    "--after-context", "--before-context", "--context", "--max-count",
    "--regexp", "--file", "--include", "--exclude", "--exclude-from",
    "--exclude-dir", "--label", "--binary-files", "--directories", "--devices",
]
RG_VALUE_FLAGS = [
    "-g", "-t", "-T", "-E", "-M", "-j", "-r",
    "--glob", "--iglob", "--type", "--type-not", "--type-add", "--encoding",
    "--engine", "--max-depth", "--max-filesize", "--max-columns", "--threads",
    "--replace", "--sort", "--sortr", "--colors", "--pre", "--ignore-file",
    "--context-separator",
]
#: What searches as grep does, flags of fd that take the next word, and predicates of find that do.
GREPS = ["grep", "egrep", "fgrep", "rg", "ag"]
FD_VALUE_FLAGS = [
    "-e", "-E", "-t", "-d", "-j", "-S", "-o",
    "--extension", "--exclude", "--type", "--max-depth", "--min-depth",
    "--search-path", "--threads", "--size", "--owner", "--base-directory",
]
FIND_VALUE_FLAGS = [
    "-path", "-ipath", "-wholename", "-iwholename", "-regex", "-iregex",
    "-maxdepth", "-mindepth", "-size", "-mtime", "-mmin", "-newer", "-user",
    "-group", "-perm", "-printf", "-fprintf", "-exec", "-execdir", "-ok",
]
PATTERN_FLAGS = ["-e", "-f", "--regexp", "--file"]
READERS, WHOLE_READERS = ["cat", "head", "tail", "less", "more", "grep", "rg"], ["cat", "head", "tail", "less", "more"]
GIT_REWRITES = ["checkout", "restore", "pull", "merge", "rebase"]


def split(command: str) -> list[tuple[str, list[str]]]:
    """(separator before, words) of each segment; nothing for a command whose quotes do not close."""
    words = shlex.shlex(command, posix=True, punctuation_chars="|&;\n")
    words.whitespace, words.whitespace_split, words.commenters = " \t\r", True, ""
    out, sep, own = [], "", []
    try:
        for word in words:
            if word and set(word) <= SEPARATORS:
                if own:
                    out.append((sep, own))
                    sep, own = word, []
                else:
                    sep = sep + word if out or sep else word
            else:
                own.append(word)
    except ValueError:
        return []
    return [*out, (sep, own)] if own else out


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [{"command": c, "seg_no": k, "sep": sep, "argv": argv} for c in batch.column("command").to_pylist() if c is not None for k, (sep, argv) in enumerate(split(c))]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("command", pa.string()), ("seg_no", pa.int32()), ("sep", pa.string()), ("argv", pa.list_(pa.string()))]))


def segments(commands: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(command, seg_no, sep, argv, head, git) of the distinct commands: head is the program's base name, git the words from the subcommand on.

    ``known`` stands in for them, where they have been made before; it may hold more.
    """
    if known is not None:
        return known
    out = commands.select("command").distinct().mapInArrow(_split, "command string, seg_no int, sep string, argv array<string>")
    out = out.withColumn("head", F.element_at(F.split(F.col("argv")[0], "/"), -1))
    return out.withColumn("git", F.when(F.col("head") == "git", F.nullif(_after_flags(F.slice("argv", F.lit(2), F.size("argv")), GIT_VALUE_FLAGS), F.expr("cast(array() as array<string>)"))))


def piped(sep: Column | str) -> Column:
    """The segment reads what the one before it wrote."""
    return F.regexp_replace(F.col(sep) if isinstance(sep, str) else sep, r"^\n+|\n+$", "").isin("|", "|&")


def _after_flags(words: Column, value_flags: list[str]) -> Column:
    """Words from the first that is no flag, nor a flag's value, on."""
    start = F.aggregate(
        words, F.struct(F.lit(0).alias("at"), F.lit(False).alias("skip"), F.lit(False).alias("done")),
        lambda a, w: F.when(a.done, a)
        .when(a.skip, F.struct((a["at"] + 1).alias("at"), F.lit(False).alias("skip"), F.lit(False).alias("done")))
        .when(F.startswith(w, F.lit("-")), F.struct((a["at"] + 1).alias("at"), w.isin(value_flags).alias("skip"), F.lit(False).alias("done")))
        .otherwise(F.struct(a["at"].alias("at"), F.lit(False).alias("skip"), F.lit(True).alias("done"))),
        lambda a: a["at"],
    )
    return F.slice(words, start + 1, F.greatest(F.size(words) - start, F.lit(0)))


def plain_words(words: Column, value_flags: Column | list[str]) -> Column:
    """Words that are neither flags nor values of ``value_flags``."""
    takes = (lambda w: w.isin(value_flags)) if isinstance(value_flags, list) else (lambda w: F.array_contains(value_flags, w))
    empty = F.expr("cast(array() as array<string>)")
    return F.aggregate(
        words, F.struct(empty.alias("out"), F.lit(False).alias("skip")),
        lambda a, w: F.when(a.skip, F.struct(a.out.alias("out"), F.lit(False).alias("skip")))
        .when(takes(w), F.struct(a.out.alias("out"), F.lit(True).alias("skip")))
        .when(F.startswith(w, F.lit("-")), F.struct(a.out.alias("out"), F.lit(False).alias("skip")))
        .otherwise(F.struct(F.concat(a.out, F.array(w)).alias("out"), F.lit(False).alias("skip"))),
        lambda a: a.out,
    )


def _args() -> Column:
    return F.slice("argv", F.lit(2), F.size("argv"))


def _paths(words: Column) -> Column:
    return F.filter(words, lambda w: (w != "") & ~w.rlike(META) & ~w.isin(".", ".."))


def _value_flags() -> Column:
    return F.when(F.col("head") == "rg", F.array(*map(F.lit, GREP_VALUE_FLAGS + RG_VALUE_FLAGS))).when(F.col("head") == "grep", F.array(*map(F.lit, GREP_VALUE_FLAGS))).otherwise(F.expr("cast(array() as array<string>)"))


def read_paths(segs: DataFrame) -> DataFrame:
    """(command, seg_no, pos, path): files that a segment may read, in order; grep's own pattern is not one of them."""
    words = _paths(plain_words(_args(), _value_flags()))
    pattern = F.col("head").isin("grep", "rg") & ~F.arrays_overlap(_args(), F.array(*map(F.lit, PATTERN_FLAGS)))
    words = F.when(pattern, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(words)
    return segs.where(F.col("head").isin(READERS)).select("command", "seg_no", F.posexplode(words).alias("pos", "path"))


def whole_reads(segs: DataFrame) -> DataFrame:
    """(command, seg_no, path): files read as a whole."""
    in_place = F.exists(_args(), lambda w: F.startswith(w, F.lit("-i")))
    sed = (F.col("head") == "sed") & F.array_contains(_args(), "-n") & ~in_place
    scripted = plain_words(_args(), [""])
    words = F.when(sed, F.slice(scripted, F.lit(2), F.greatest(F.size(scripted) - 1, F.lit(0)))).otherwise(plain_words(_args(), ["-n", "-c"]))
    return segs.where(F.col("head").isin(WHOLE_READERS) | sed).select("command", "seg_no", F.explode(_paths(words)).alias("path"))


def mutations(segs: DataFrame) -> DataFrame:
    """(command, seg_no, path, label): files a segment changes; path is null for git commands that may rewrite any."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("argv")), lambda k: F.struct(F.get("argv", k - 1).alias("w"), F.get("argv", k).alias("next")))
    bare, joined = r"^\d?>>?$", r"^\d?>>?(.+)$"  # fixed values: a redirection, and one with its file
    to = F.transform(F.filter(pairs, lambda p: p.w.rlike(r"^\d?>>?")), lambda p: F.when(p.w.rlike(bare), p.next).otherwise(F.regexp_extract(p.w, joined, 1)))
    to = F.filter(_paths(F.array_compact(to)), lambda w: w != "/dev/null")
    redirected = segs.select("command", "seg_no", F.explode(to).alias("path"), F.col("head").alias("label"))
    in_place = (F.col("head") == "sed") & F.exists(_args(), lambda w: F.startswith(w, F.lit("-i")))
    words = plain_words(_args(), [""])
    words = F.when(in_place, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(words)
    named = segs.where(in_place | F.col("head").isin("tee", "mv", "rm")).select("command", "seg_no", F.explode(_paths(words)).alias("path"), F.col("head").alias("label"))
    sub, rest = F.col("git")[0], F.slice("git", F.lit(2), F.size("git"))
    branch = (sub == "checkout") & F.arrays_overlap(rest, F.array(F.lit("-b"), F.lit("-B"), F.lit("--orphan")))
    wild = F.when(sub.isin(GIT_REWRITES) & ~branch, F.concat(F.lit("git "), sub)).when((sub == "stash") & F.get(rest, F.lit(0)).isin("pop", "apply"), F.concat(F.lit("git stash "), F.get(rest, F.lit(0))))
    rewritten = segs.where("git IS NOT NULL").select("command", "seg_no", F.lit(None).cast("string").alias("path"), wild.alias("label")).where("label IS NOT NULL")
    return redirected.unionByName(named).unionByName(rewritten)


def commits(segs: DataFrame) -> DataFrame:
    """(command): commands with a segment that commits."""
    return segs.where(F.col("git")[0] == "commit").select("command").distinct()


def _fold(words: Column, start: dict[str, Column], step) -> Column:
    """words folded into a struct; ``step`` (state, word) gives the fields that change."""
    zero = F.struct(*[v.alias(k) for k, v in start.items()])
    return F.aggregate(words, zero, lambda a, w: F.struct(*[{**{k: a[k] for k in start}, **step(a, w)}[k].alias(k) for k in start]))


def _case(*cases: tuple[Column, Column], otherwise: Column) -> Column:
    out = None
    for when, then in cases:
        out = F.when(when, then) if out is None else out.when(when, then)
    return out.otherwise(otherwise)


def _grep(args: Column, rg: Column) -> Column:
    """struct<pattern, paths, recursive, dropped>: what a grep looks for. Inverted matches and patterns from files are dropped."""
    takes = lambda w: w.isin(GREP_VALUE_FLAGS) | (rg & w.isin(RG_VALUE_FLAGS))
    dash = lambda w: F.startswith(w, F.lit("-")) & (F.length(w) > 1)
    long = lambda w: F.startswith(w, F.lit("--"))

    def step(a: Column, w: Column) -> dict[str, Column]:
        value = a["next"] != ""  # this word belongs to the flag before it
        flag, plain = ~value & dash(w), ~value & ~dash(w)
        own = flag & ~takes(w) & ~long(w)  # letters of a cluster
        return {
            "pattern": _case((value & (a["next"] == "pattern"), F.coalesce(a["pattern"], w)), (plain & a["pattern"].isNull(), w), otherwise=a["pattern"]),
            "paths": a["paths"] + F.when(plain & a["pattern"].isNotNull(), 1).otherwise(0),
            "recursive": a["recursive"] | (flag & long(w) & ((w == "--recursive") | F.startswith(w, F.lit("--include")))) | (own & w.rlike("[rR]")),
            "dropped": a["dropped"] | (flag & w.isin("--invert-match", "--file", "-f")) | (own & w.contains("v")),
            "next": _case((flag & w.isin("-e", "--regexp"), F.lit("pattern")), (flag & takes(w), F.lit("value")), otherwise=F.lit("")),
        }

    start = {"pattern": F.lit(None).cast("string"), "paths": F.lit(0), "recursive": F.lit(False), "dropped": F.lit(False), "next": F.lit("")}
    return _fold(args, start, step)


def _find(args: Column) -> Column:
    """struct<names, dirs, pruned>: names that a find looks for, and whether it asks for directories; what ! or -not precedes does not count."""

    def step(a: Column, w: Column) -> dict[str, Column]:
        value = a["next"] != ""
        turn = ~value & w.isin("!", "-not")
        name, kind = ~value & w.isin("-name", "-iname"), ~value & (w == "-type")
        return {
            "names": F.when(value & (a["next"] == "name") & ~a["negated"], F.concat(a["names"], F.array(w))).otherwise(a["names"]),
            "dirs": a["dirs"] | (value & (a["next"] == "type") & (w == "d") & ~a["negated"]),
            "pruned": a["pruned"] | (~value & (w == "-prune")),
            "negated": turn | (a["negated"] & (name | kind | (~value & w.isin("(", ")")))),
            "next": _case((name, F.lit("name")), (kind, F.lit("type")), (~value & w.isin(FIND_VALUE_FLAGS), F.lit("value")), otherwise=F.lit("")),
        }

    start = {"names": F.expr("cast(array() as array<string>)"), "dirs": F.lit(False), "pruned": F.lit(False), "negated": F.lit(False), "next": F.lit("")}
    return _fold(args, start, step)


def _fd(args: Column) -> Column:
    """The pattern of an fd; null if it runs a command before it gives one."""

    def step(a: Column, w: Column) -> dict[str, Column]:
        live = ~a["done"] & ~a["skip"]
        flag = F.startswith(w, F.lit("-"))
        return {
            "pattern": F.when(live & ~flag, w).otherwise(a["pattern"]),
            "done": a["done"] | (live & (~flag | w.isin("-x", "--exec", "-X", "--exec-batch"))),
            "skip": live & w.isin(FD_VALUE_FLAGS),
        }

    return _fold(args, {"pattern": F.lit(None).cast("string"), "done": F.lit(False), "skip": F.lit(False)}, step)["pattern"]


def quoted(words: Column) -> Column:
    """Words joined as a shell would read them again."""
    plain = lambda w: w.rlike(r"^[A-Za-z0-9_@%+=:,./-]+$")
    return F.array_join(F.transform(words, lambda w: F.when(plain(w), w).otherwise(F.concat(F.lit("'"), F.replace(w, F.lit("'"), F.lit("'\"'\"'")), F.lit("'")))), " ")


def digest(segs: DataFrame) -> DataFrame:
    """(command, segments, listings, ls_only, items array<struct<seg_no, probe_no, label, pattern, glob, layout, confidence>>): one row per command.

    An item's pattern is what grep and its like, git grep, find and fd search; a filter in mid-pipe without paths or recursion looks through
    output and not for a word of the project, so it is left out. An item's layout is a tree or a find for directories as it was written, or, as a heuristic,
    two or more listings of directories; its pattern is null then.
    """
    git = F.coalesce(F.col("git")[0] == "grep", F.lit(False))
    args = F.when(git, F.slice("git", F.lit(2), F.size("git"))).otherwise(_args())
    grep = git | F.col("head").isin(GREPS)
    segs = segs.withColumn("args", args).withColumn("label", F.when(git, F.lit("git grep")).otherwise(F.col("head")))
    segs = segs.withColumn("g", F.when(grep, _grep(F.col("args"), F.col("head") == "rg"))).withColumn("f", F.when(F.col("head") == "find", _find(F.col("args"))))
    filtering = piped("sep") & (F.col("g.paths") == 0) & ~F.col("g.recursive")
    none = F.expr("cast(array() as array<string>)")
    names = F.when(F.col("f.pruned"), none).otherwise(F.col("f.names"))
    patterns = F.when(grep, F.array(F.when(~F.col("g.dropped") & ~filtering, F.col("g.pattern")))).when(F.col("head") == "find", names).when(F.col("head") == "fd", F.array(_fd(F.col("args"))))
    found = F.filter(F.coalesce(patterns, none), lambda p: p.isNotNull() & (p != ""))
    listing = F.col("head") == "ls"
    layout = (F.col("head") == "tree") | F.coalesce(F.col("f.dirs") & (F.size(names) == 0), F.lit(False))
    raw = F.when(layout | listing, quoted(F.col("argv")))
    own = F.struct("seg_no", listing.alias("ls"), layout.alias("layout"), raw.alias("raw"), "label", (~grep).alias("glob"), found.alias("found"))
    per = segs.groupBy("command").agg(F.array_sort(F.collect_list(own)).alias("s"))
    item = lambda no, probe, label, pattern, glob, shown, sure: F.struct(no.alias("seg_no"), probe.alias("probe_no"), label.alias("label"), pattern.cast("string").alias("pattern"), glob.alias("glob"), F.left(T.scrub(shown.cast("string")), F.lit(200)).alias("layout"), F.lit(sure).alias("confidence"))
    empty = F.expr("cast(array() as array<struct<seg_no:int,probe_no:int,label:string,pattern:string,glob:boolean,layout:string,confidence:string>>)")
    null, zero = F.lit(None), F.lit(0)
    searched = F.flatten(F.transform("s", lambda x: F.when(x.layout, F.array(item(x.seg_no, zero, x.label, null, F.lit(False), x.raw, "exact"))).otherwise(F.transform(x.found, lambda p, k: item(x.seg_no, k, x.label, p, x["glob"], null, "exact")))))
    listed = F.filter("s", lambda x: x.ls)
    several = F.when(F.size(listed) >= 2, F.array(item(F.lit(1 << 20), zero, F.lit("ls"), null, F.lit(False), F.array_join(F.transform(listed, lambda x: x.raw), "; "), "heuristic"))).otherwise(empty)
    return per.select("command", F.size("s").cast("long").alias("segments"), F.size(listed).cast("long").alias("listings"), ((F.size("s") == 1) & (F.size(listed) == 1)).alias("ls_only"), F.concat(searched, several).alias("items"))


def searches(segs: DataFrame) -> DataFrame:
    """(command, seg_no, probe_no, label, pattern, glob) of the segments' searches."""
    return digest(segs).select("command", F.inline("items")).where("pattern IS NOT NULL").drop("layout", "confidence")


def call_summary(segs: DataFrame) -> DataFrame:
    """Per command: searches, layout probes (tree, find for directories, two ls or more), and whether it only lists."""
    count = lambda c: F.size(F.filter("items", lambda x: x[c].isNotNull())).cast("long")
    return digest(segs).select("command", "segments", count("pattern").alias("searches"), count("layout").alias("layouts"), "ls_only")
