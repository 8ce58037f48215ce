"""What sessions cost, by a price table of model-name prefixes: (prefix, in_usd, out_usd) per million tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .inventory import static_tokens

#: Writing to and reading from the prompt cache, relative to plain input.
CACHE_WRITE, CACHE_READ = 1.25, 0.10


def priced_models(models: DataFrame, prices: DataFrame) -> DataFrame:
    """(model, in_usd, out_usd): each distinct model with the price of its longest prefix; null where none fits.

    A model meets the prices by its own prefixes, so this is a hash join for a price table of any size.
    """
    names = models.select("model").where("model IS NOT NULL").distinct()
    cut = names.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("model"), F.lit(1))), lambda k: F.left("model", k))))
    best = cut.join(prices, "prefix").groupBy("model").agg(F.max_by(F.struct("in_usd", "out_usd"), F.length("prefix")).alias("p"))
    return names.join(best, "model", "left").select("model", "p.in_usd", "p.out_usd")


def message_costs(messages: DataFrame, prices: DataFrame) -> DataFrame:
    """messages (session_id, model, input, output, cache_creation, cache_read) with cost_usd (null for unpriced models) and context tokens."""
    priced = messages.join(priced_models(messages, prices), "model", "left")
    paid = (F.col("input") + F.col("cache_creation") * CACHE_WRITE + F.col("cache_read") * CACHE_READ) * F.col("in_usd") + F.col("output") * F.col("out_usd")
    return priced.withColumn("cost_usd", paid / 1e6).withColumn("context", F.col("input") + F.col("cache_creation") + F.col("cache_read"))


def session_costs(messages: DataFrame, prices: DataFrame, static: int | DataFrame) -> DataFrame:
    """Per session: cost, the share of it that always-loaded text causes, and models without a price.

    static: tokens of the always-loaded text, one number or (session_id, static_tokens); a session without a row has none.
    The share of a message is its cost times the part of its context, one at most, that the static text fills.
    """
    costs = message_costs(messages, prices)
    if isinstance(static, DataFrame):
        costs = costs.join(static.select("session_id", "static_tokens"), "session_id", "left")
        static = F.coalesce("static_tokens", F.lit(0))
    else:
        static = F.lit(static)
    share = F.when(F.col("context") > 0, F.least(F.lit(1.0), static / F.col("context"))).otherwise(0.0)
    unpriced = F.array_sort(F.collect_set(F.when(F.col("in_usd").isNull(), F.col("model"))))
    out = costs.groupBy("session_id").agg(F.round(F.sum("cost_usd"), 6).alias("cost_usd"), F.round(F.sum(F.col("cost_usd") * share), 6).alias("static_usd"), unpriced.alias("unpriced"))
    return out


def static_basis(components: DataFrame, owned: DataFrame) -> DataFrame:
    """(session_id, static_tokens): what is always in context in each session's own repository."""
    per = static_tokens(components).groupBy("repo_id").agg(F.sum("static_tokens").alias("static_tokens"))
    return owned.select("session_id", "repo_id").join(per, "repo_id").select("session_id", "static_tokens")
