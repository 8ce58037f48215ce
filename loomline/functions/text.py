"""Column functions over text: estimates, cleaning, keys, paths, markers. All stay inside Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ESC, BEL = "\x1b", "\x07"
#: Fixed keys of action facts.
LAYOUT_KEY, CODE_KEY = "repo layout", "code structure"
#: Words that open a declaration, and words that are syntax rather than vocabulary.
DECLARATIONS = [
    "def", "class", "function", "func", "fn", "struct", "interface",
    "impl", "trait", "enum", "const", "import", "from", "use",
    "require", "#include", "package",
]
SYNTAX_WORDS = [
    "len", "self", "this", "super", "return", "import", "print",
    "init", "main", "async", "await", "yield", "lambda",
    "null", "none", "nil", "true", "false",
]


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def token_estimate(c: Column | str) -> Column:
    """UTF-8 bytes over four, rounded up; null for null."""
    return F.ceil(F.octet_length(_c(c)) / 4).cast("long")


def scrub(c: Column | str) -> Column:
    """Without terminal control sequences, then without the remaining control characters but tab and newline."""
    # Fixed value: the pattern.
    whole = F.regexp_replace(_c(c), rf"{ESC}\[[0-9;?]*[ -/]*[@-~]|{ESC}\][^{BEL}{ESC}]*(?:{BEL}|{ESC}\\)?", "")
    return F.regexp_replace(whole, r"[\x00-\x08\x0b-\x1f\x7f\x{80}-\x{9f}]", "")


def strip(c: Column | str) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def alternatives(c: Column | str) -> Column:
    """The parts of a pattern between bars, escaped or not; the whole pattern if no part has text."""
    c = _c(c)
    found = F.filter(F.split(F.replace(c, F.lit("\\|"), F.lit("|")), r"\|"), lambda x: strip(x) != "")
    return F.when(F.size(found) > 0, found).otherwise(F.array(c))


def canonical_key(c: Column | str) -> Column:
    """A pattern without regex noise and signs, in lower case; the trimmed original where under three characters remain."""
    c = _c(c)
    bare = F.regexp_replace(F.regexp_replace(c, r"\\[A-Za-z]", ""), r"\{\d*,?\d*\}", "")
    key = F.lower(F.regexp_replace(bare, r"[^0-9A-Za-z\x{4e00}-\x{9fff}]", ""))
    return F.when(F.length(key) < 3, F.lower(strip(c))).otherwise(key)


def folded(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(_c(c)), r"[^0-9a-z]", "")


def syntax_class(part: Column | str, glob: Column) -> Column:
    """struct<structure boolean, keyword string, confidence string>: whether a search part probes syntax, or what word remains of it."""
    # Fixed value: the pattern.
    text = strip(F.regexp_replace(_c(part), r"\\[A-Za-z][*+?]?|\{\d*,?\d*\}|[\^$]", " "))
    out = lambda s, k, c: F.struct(F.lit(s).alias("structure"), k.cast("string").alias("keyword"), F.lit(c).alias("confidence"))
    none = F.lit(None)
    plain = out(False, none, "exact")
    word = F.substring_index(F.lower(text), " ", 1)
    rest = strip(F.substr(text, F.length(word) + 1))
    declared = F.when(folded(rest) == "", out(True, none, "exact")).when(F.contains(rest, F.lit(" ")), plain).otherwise(out(False, rest, "exact"))
    pieces = F.filter(F.split(text, r"[*?\[\]{}]+|/"), lambda s: (s != "") & ~F.startswith(s, F.lit(".")))
    pieces = F.filter(pieces, lambda s: s.rlike(r"[^\x00-\x7f]") | (F.length(folded(s)) > 3))
    longest = F.aggregate(pieces, F.lit(""), lambda a, s: F.when(F.length(s) > F.length(a), s).otherwise(a))
    common = folded(text).isin(SYNTAX_WORDS)
    globbed = (
        F.when(F.size(pieces) == 0, out(True, none, "exact"))
        .when(folded(longest).isin(SYNTAX_WORDS), out(True, none, "heuristic"))
        .when(longest != text, out(False, longest, "exact"))
        .when(common, out(True, none, "heuristic"))
        .otherwise(plain)
    )
    return F.when(word.isin(DECLARATIONS), declared).when(glob & text.rlike(r"[*?\[\]{}]+|/"), globbed).when(common, out(True, none, "heuristic")).otherwise(plain)


def relative_path(path: Column | str, root: Column | str) -> Column:
    """The path below ``root``, or the path as it is."""
    path, base = _c(path), F.concat(_c(root), F.lit("/"))
    return F.when(F.startswith(path, base), F.substr(path, F.length(base) + 1)).otherwise(path)


def absolute_path(path: Column | str, cwd: Column | str) -> Column:
    """Joined to ``cwd`` where relative, with "." and ".." resolved."""
    path = _c(path)
    whole = F.when(F.startswith(path, F.lit("/")) | _c(cwd).isNull(), path).otherwise(F.concat(_c(cwd), F.lit("/"), path))
    steps = F.aggregate(
        F.split(whole, "/"), F.expr("cast(array() as array<string>)"),
        lambda a, s: F.when((s == "") | (s == "."), a).when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))),
    )
    return F.concat(F.when(F.startswith(whole, F.lit("/")), F.lit("/")).otherwise(F.lit("")), F.array_join(steps, "/"))


def path_under(path: Column | str, root: Column | str) -> Column:
    """The resolved path relative to ``root``; null outside it."""
    at = absolute_path(path, root)
    return F.when(within(at, root), F.substr(at, F.length(_c(root)) + 2))


def within(path: Column | str, base: Column | str) -> Column:
    """Equal to the directory, or below it."""
    return (_c(path) == _c(base)) | F.startswith(_c(path), F.concat(_c(base), F.lit("/")))


def path_in_text(path: Column, text: Column, cwd: Column) -> Column:
    """The path, or its form relative to ``cwd``, occurs in the text."""
    base = F.regexp_replace(cwd, "/+$", "")
    below = F.startswith(path, F.concat(base, F.lit("/"))) & F.contains(text, relative_path(path, base))
    return F.contains(text, path) | F.coalesce(below & (cwd != ""), F.lit(False))


def ancestors(path: Column | str) -> Column:
    """Every directory above a relative path, outermost first."""
    steps = F.split(_c(path), "/")
    return F.when(F.size(steps) < 2, F.expr("cast(array() as array<string>)")).otherwise(F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/")))


def read_range(offset: Column, limit: Column) -> Column:
    """struct<first, last> of lines read; null for a whole file, last null for an open end."""
    first = F.when(offset > 0, offset).otherwise(F.lit(1)).cast("long")
    return F.when(offset.isNotNull() | limit.isNotNull(), F.struct(first.alias("first"), (first + limit - 1).alias("last")))


def boilerplate(c: Column | str) -> Column:
    """Text that the program wrote for the user."""
    return F.startswith(_c(c), F.lit("<")) | F.startswith(_c(c), F.lit("Caveat:"))


def command_name(c: Column | str) -> Column:
    """The command that a message invokes, by marker or leading slash; null for none."""
    # Fixed value: the pattern.
    marked = F.regexp_extract(strip(c), r"^<command-name>/?([^<\s]+)</command-name>", 1)
    slashed = F.regexp_extract(_c(c), r"^/+([^\s/]\S*)", 1)
    return F.nullif(F.when(marked != "", marked).otherwise(slashed), F.lit(""))


def server_tool(c: Column | str) -> Column:
    """struct<server, tool> of a server tool's name; null for others."""
    # Fixed value: the pattern.
    name, pattern = _c(c), r"^mcp__([^_]+(?:_[^_]+)*?)__(.+)$"
    return F.when(name.rlike(pattern), F.struct(F.regexp_extract(name, pattern, 1).alias("server"), F.regexp_extract(name, pattern, 2).alias("tool")))


def commit_confirmed(c: Column | str) -> Column:
    """A result that shows a commit was made."""
    # Fixed value: the pattern.
    return _c(c).rlike(r"\[[^\]]+ [0-9a-f]{7,}\]|files? changed")


def agent_tagged(detail: Column | str, sidechain: Column | str, agent: Column | str) -> Column:
    """The detail, after the subagent that acted."""
    tag = F.when(_c(agent).isNull(), F.lit("[subagent] ")).otherwise(F.concat(F.lit("[subagent:"), _c(agent), F.lit("] ")))
    return F.when(_c(sidechain), F.concat(tag, scrub(detail))).otherwise(scrub(detail))


def even_share(tokens: Column | str, parts: Column | str) -> Column:
    """Whole tokens for each of ``parts``; null for no parts."""
    return F.floor(_c(tokens) / F.nullif(_c(parts), F.lit(0))).cast("long")


def scale_tier(peak: Column | str, configured: int = 200_000, tiers: tuple[int, ...] = (200_000, 1_000_000)) -> Column:
    """The configured window, or for a larger peak the least tier that holds it, or the peak."""
    peak = _c(peak)
    fitting = F.filter(F.array(*[F.lit(t).cast("long") for t in tiers]), lambda t: t >= peak)
    return F.when(peak <= configured, F.lit(configured).cast("long")).otherwise(F.coalesce(F.array_min(fitting), peak))


def block_level(estimate: Column | str, largest: Column | str) -> Column:
    """1 to 8, by the square root of the share; halves go to the even level."""
    return F.greatest(F.lit(1), F.bround(F.sqrt(_c(estimate) / F.nullif(_c(largest), F.lit(0))) * 8).cast("int"))


def short_number(c: Column | str) -> Column:
    c = _c(c)
    short = lambda unit: F.regexp_replace(F.format_string("%.1f", c / unit), r"\.0$", "")
    return F.when(c >= 1_000_000, F.concat(short(1_000_000), F.lit("M"))).when(c >= 1_000, F.concat(short(1_000), F.lit("k"))).otherwise(c.cast("string"))


def supported_version(c: Column | str, pattern: str = r"^2\.1\.\d+$") -> Column:
    return F.coalesce(_c(c).rlike(pattern), F.lit(False))


def slug(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(c), "[^A-Za-z0-9]+", "-"), "^-+|-+$", "")
