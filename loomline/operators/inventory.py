"""The registry of components, from repository files: (repo_id, path, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import text as T

STATES = {
    "skill": ["registered", "loaded", "invoked"], "command": ["registered", "invoked"], "agent": ["registered", "invoked"], "hook": ["registered", "invoked"],
    "server": ["registered", "invoked"], "guide": ["registered", "loaded"], "file": ["registered", "loaded"],
}


def _row(files: DataFrame, kind: str, name: Column, context: str, tokens: Column, meta: Column | None = None, body: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("long")
    return files.select(
        "repo_id", F.concat(F.lit(f"{kind}:"), name).alias("id"), F.lit(kind).alias("type"), name.alias("name"), F.lit(context).alias("context"), F.lit("local").alias("provenance"), F.lit(None).cast("string").alias("source"), "path",
        F.array(*map(F.lit, STATES[kind])).alias("states"), tokens.alias("tokens_est"), (none if meta is None else meta).alias("tokens_meta_est"), (none if body is None else body).alias("tokens_body_est"),
        F.lit(None).cast("string").alias("miss_when"), F.lit(False).alias("missing"), F.lit(None).cast("string").alias("hook_event"), F.expr("cast(null as array<string>)").alias("hook_commands"),
    )


def front_matter(text: Column | str) -> Column:
    """struct<meta, body>: what stands between the first two --- lines, and the rest."""
    text = F.col(text) if isinstance(text, str) else text
    parts = F.split(text, "---", 3)
    has = F.startswith(text, F.lit("---")) & (F.size(parts) == 3)
    return F.struct(F.when(has, parts[1]).otherwise("").alias("meta"), F.when(has, parts[2]).otherwise(text).alias("body"))


def skills(files: DataFrame, under: str = ".claude/skills/") -> DataFrame:
    own = files.where(F.startswith("path", F.lit(under)) & F.endswith("path", F.lit("/SKILL.md"))).withColumn("f", front_matter("text"))
    return _row(own, "skill", F.element_at(F.split("path", "/"), -2), "dynamic", T.token_estimate("text"), T.token_estimate("f.meta"), T.token_estimate("f.body"))


def commands(files: DataFrame, under: str = ".claude/commands/") -> DataFrame:
    """Sub-directories join into the name by colons."""
    own = files.where(F.startswith("path", F.lit(under)) & F.endswith("path", F.lit(".md")))
    return _row(own, "command", F.replace(F.regexp_replace(F.substr("path", F.lit(len(under) + 1)), r"\.md$", ""), F.lit("/"), F.lit(":")), "dynamic", T.token_estimate("text"))


def agents(files: DataFrame, under: str = ".claude/agents/") -> DataFrame:
    own = files.where(F.startswith("path", F.lit(under)) & F.endswith("path", F.lit(".md")))
    return _row(own, "agent", F.regexp_replace(F.regexp_replace("path", "^.*/", ""), r"\.md$", ""), "static", T.token_estimate("text"))


def guides(files: DataFrame, guide: str = "CLAUDE.md") -> DataFrame:
    """A guidance file at the root is always there; one below comes with its directory."""
    own = files.where((F.col("path") == guide) | F.endswith("path", F.lit(f"/{guide}")))
    name = F.when(F.col("path") == guide, "root").otherwise(T.slug(F.regexp_replace("path", r"/[^/]+$", "")))
    return _row(own, "guide", name, "dynamic", T.token_estimate("text")).withColumn("context", F.when(F.col("name") == "root", "static").otherwise("dynamic"))


def hooks(files: DataFrame, settings: str = ".claude/settings.json") -> DataFrame:
    """One component per group of a settings file; its identity is the digest of matcher and commands, equal groups are numbered."""
    own = files.where(F.col("path") == settings).withColumn("groups", F.expr("try_variant_get(try_parse_json(text), '$.hooks', 'map<string, array<variant>>')"))
    own = own.select("repo_id", "path", F.explode("groups").alias("event", "list")).select("repo_id", "path", "event", F.posexplode("list").alias("pos", "g"))
    matcher = F.expr("try_variant_get(g, '$.matcher', 'string')")
    found = F.array_compact(F.expr("transform(coalesce(try_variant_get(g, '$.hooks', 'array<variant>'), array()), h -> nullif(try_variant_get(h, '$.command', 'string'), ''))"))
    own = own.withColumn("matcher", matcher).withColumn("commands", found)
    digest = F.left(F.sha1(F.to_json(F.struct(F.coalesce("matcher", F.lit("")).alias("m"), F.col("commands").alias("c")))), F.lit(8))
    base = F.concat_ws("-", "event", F.when(F.coalesce("matcher", F.lit("")) == "", "all").otherwise(T.slug("matcher")), digest)
    own = own.withColumn("base", base).withColumn("no", F.row_number().over(Window.partitionBy("repo_id", "base").orderBy("pos")))
    name = F.when(F.col("no") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("no").cast("string")))
    covers = F.coalesce("matcher", F.lit("")).isin("", "*") | F.col("matcher").rlike(r"(?i)\bBash\b|\bgit\b")
    rows = own.select("repo_id", "path", "event", "commands", name.alias("n"), F.when((F.col("event") == "PreToolUse") & covers, "git_commit").alias("m"))
    out = _row(rows.withColumn("text", F.lit("")), "hook", F.col("n"), "static", F.lit(0).cast("long"))
    extra = rows.select("repo_id", F.col("n").alias("name"), "m", "event", "commands")
    return out.drop("miss_when", "hook_event", "hook_commands").join(extra, ["repo_id", "name"]).withColumnsRenamed({"m": "miss_when", "event": "hook_event", "commands": "hook_commands"}).select(out.columns)


def servers(files: DataFrame, config: str = ".mcp.json") -> DataFrame:
    own = files.where(F.col("path") == config).select("repo_id", "path", F.explode(F.expr("try_variant_get(try_parse_json(text), '$.mcpServers', 'map<string, variant>')")).alias("server", "spec"))
    own = own.withColumn("text", F.to_json("spec"))
    return _row(own, "server", F.col("server"), "static", T.token_estimate("text"))


def scan(files: DataFrame, plugins: DataFrame | None = None) -> DataFrame:
    """All components of all repositories, with ids made unique: a repository's own come before those of plugins (``plugin_scan``)."""
    out = skills(files)
    for part in (commands, agents, guides, hooks, servers):
        out = out.unionByName(part(files))
    if plugins is not None:
        out = out.unionByName(plugins)
    return unique_ids(out.withColumn("late", F.col("provenance") != "local"), ["late", "type", "source", "path", "name"]).drop("late")


#: Where a home keeps its settings and the list of installed plugins.
HOME_SETTINGS, HOME_PLUGINS = ".claude/settings.json", ".claude/plugins/installed_plugins.json"


def enabled_plugins(homes: DataFrame) -> DataFrame:
    """(home_id, plugin, root): plugins that a home's settings enable and that its list says where to find; homes: files (home_id, path, text) below the home."""
    on = homes.where(F.col("path") == HOME_SETTINGS).select("home_id", F.explode(F.expr("try_variant_get(try_parse_json(text), '$.enabledPlugins', 'map<string, boolean>')")).alias("full", "on")).where("on")
    at = homes.where(F.col("path") == HOME_PLUGINS).select("home_id", F.explode(F.expr("try_variant_get(try_parse_json(text), '$.plugins', 'map<string, variant>')")).alias("full", "entries"))
    at = at.withColumn("root", F.expr("try_variant_get(entries, '$[0].installPath', 'string')")).where("root <> ''")
    return at.join(on, ["home_id", "full"], "left_semi").select("home_id", F.substring_index("full", "@", 1).alias("plugin"), F.regexp_replace("root", "/+$", "").alias("root"))


def plugin_scan(homes: DataFrame, trees: DataFrame, repos: DataFrame) -> DataFrame:
    """Components of the plugins that each repository's home has installed and enabled.

    trees: files (home_id, path, text) with whole paths; repos: (repo_id, home_id). The settings decide which folders are scanned: a file meets the plugins' roots by its own
    ancestors, by equality. A plugin is scanned once for its home, whatever repositories there are.
    """
    roots = enabled_plugins(homes)
    above = F.transform(T.ancestors(F.substr("path", F.lit(2))), lambda p: F.concat(F.lit("/"), p))
    own = trees.withColumn("root", F.explode(above)).join(roots, ["home_id", "root"])
    # Each plugin of a home is a tree of its own, as a repository is.
    key = F.to_json(F.struct(F.col("home_id").cast("string").alias("h"), "plugin", "root"))
    own = own.select(key.alias("repo_id"), F.substr("path", F.length("root") + 2).alias("path"), "text")
    out = skills(own, "skills/")
    for part in (commands(own, "commands/"), agents(own, "agents/"), hooks(own, "hooks/hooks.json"), servers(own)):
        out = out.unionByName(part)
    of = lambda c: F.get_json_object("repo_id", f"$.{c}")
    out = out.withColumns({"home": of("h"), "source": F.concat(F.lit("plugin:"), of("plugin")), "path": F.concat_ws("/", of("root"), "path"), "provenance": F.lit("plugin")})
    owners = repos.select(F.col("repo_id").alias("owner"), F.col("home_id").cast("string").alias("home"))
    return out.join(owners, "home").withColumn("repo_id", F.col("owner")).drop("home", "owner")


def plugin_components(installed: DataFrame, enabled: DataFrame, components: DataFrame) -> DataFrame:
    """Components (plugin, ...) of plugins that are both installed and enabled, marked as such."""
    own = installed.join(enabled, "plugin", "left_semi").select("plugin")
    return components.join(own, "plugin").withColumn("provenance", F.lit("plugin")).withColumn("source", F.concat(F.lit("plugin:"), "plugin")).drop("plugin")


def unique_ids(components: DataFrame, order: list[str], by: str = "repo_id") -> DataFrame:
    """Later rows of one id get @provenance, and further ones of that provenance a number from 2."""
    same = Window.partitionBy(by, "id").orderBy(*order)
    rows = components.withColumn("no", F.row_number().over(same))
    again = F.row_number().over(Window.partitionBy(by, "id", "provenance", F.col("no") > 1).orderBy(*order))
    rows = rows.withColumn("again", again)
    new = F.concat("id", F.lit("@"), "provenance", F.when(F.col("again") > 1, F.concat(F.lit("-"), F.col("again").cast("string"))).otherwise(""))
    return rows.withColumn("id", F.when(F.col("no") > 1, new).otherwise(F.col("id"))).drop("no", "again")


def refreshed(old: DataFrame, new: DataFrame, key: list[str], edited: list[str]) -> DataFrame:
    """old brought up to new: what vanished is missing, what stays keeps its edited columns, what is new comes in."""
    rest = [c for c in old.columns if c not in key and c not in edited and c != "missing"]
    n = new.select(*key, *[F.col(c).alias(f"n_{c}") for c in [*rest, *edited]], F.lit(True).alias("here"))
    o = old.select(*key, *[F.col(c).alias(f"o_{c}") for c in [*rest, *edited]], F.lit(True).alias("was"))
    out = o.join(n, key, "full")
    pick = [F.when(F.col("here"), F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c) for c in rest] + [F.when(F.col("was"), F.col(f"o_{c}")).otherwise(F.col(f"n_{c}")).alias(c) for c in edited]
    return out.select(*key, *pick, F.col("here").isNull().alias("missing"))


def in_context(components: DataFrame) -> tuple[Column, Column]:
    """Tokens that are always in context, and those that come on use: a skill's front matter and its body, else all of a static or of a dynamic component."""
    known = lambda c: F.col(c) if c in components.columns else F.lit(None)
    skill, static = F.col("type") == "skill", F.col("context") == "static"
    always = F.when(skill & known("tokens_meta_est").isNotNull(), known("tokens_meta_est")).when(~skill & static, F.col("tokens_est"))
    used = F.when(skill, known("tokens_body_est")).when(F.col("context") == "dynamic", F.col("tokens_est"))
    return F.coalesce(always, F.lit(0)).cast("long"), F.coalesce(used, F.lit(0)).cast("long")


def static_tokens(components: DataFrame) -> DataFrame:
    """(repo_id where known, id, static_tokens) of what is always in context, largest first: a skill's front matter, else all of a static component."""
    key = ["repo_id"] if "repo_id" in components.columns else []
    always, _ = in_context(components)
    return components.where("NOT missing").select(*key, "id", always.alias("static_tokens")).where("static_tokens > 0").orderBy(F.desc("static_tokens"), *key, "id")


def largest(components: DataFrame, n: int = 12) -> DataFrame:
    """(repo_id, no, id, static_tokens, share): the n of each repository that hold most of what is always in context, and their percentage of all of it."""
    rows = static_tokens(components)
    total = rows.groupBy("repo_id").agg(F.sum("static_tokens").alias("total"))
    top = rows.withColumn("no", F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("static_tokens"), "id"))).where(F.col("no") <= n)
    return top.join(total, "repo_id").select("repo_id", "no", "id", "static_tokens", F.round(F.col("static_tokens") * 100.0 / F.col("total"), 1).alias("share"))


def summary(components: DataFrame) -> DataFrame:
    """Counts and tokens by type, by provenance, and in all; what is missing does not count."""
    rows = components.where("NOT missing") if "missing" in components.columns else components
    always, used = in_context(rows)
    g = rows.groupingSets([["type"], ["provenance"], []], "type", "provenance")
    return g.agg(F.count("*").alias("components"), F.sum(always).alias("static_tokens"), F.sum(used).alias("dynamic_tokens"))


def with_names(components: DataFrame) -> DataFrame:
    """A missing name is the id without its type and the suffix that made it unique."""
    bare = F.regexp_replace(F.regexp_replace("id", "^[^:]+:", ""), r"@(?:local|global|plugin)(?:-\d+)?$", "")
    return components.withColumn("name", F.coalesce(F.nullif("name", F.lit("")), bare))
