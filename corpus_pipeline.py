"""A corpus from documents to packed sequences: quality, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next
one's docs. All but the last keep the columns of ``documents``.

Cases. Null texts are empty ones throughout. The repeated-passage stage gives back texts, so a removed run
that begins or ends inside a character leaves that character whole; n_chars is counted anew for changed texts, and a text that
was null stays so. Empty tables pass through. Extra columns pass through all stages but the last.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomline.llm import jaccard_join, packing, quality, suffix_dedup
from loomline.llm._sieve import may, sieve
from loomline.llm._spark import NO_ID, drop, numbered, stash, table, texts


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It learns from the labels of documents outside the held-out fold, as the query does."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).where(~quality.held_out())
    model = quality.train(texts(table(spark, sf_dir, "documents")), labels)
    return docs.where(quality.scores(model, spark)("text") >= quality.CUT)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of each group of near duplicates; rows that share an id are documents of their own."""
    rows = numbered(docs)
    if rows is not None:
        rest = jaccard_join.jaccard_join(rows, "__row").where("kept").select(F.col("doc_id").alias("__row"))
        return rows.join(rest, "__row", "left_semi").drop("__row")
    rest = jaccard_join.jaccard_join(docs).where("kept").select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(rest, F.col("doc_id").eqNullSafe(F.col("__kept")), "left_semi")


@F.arrow_udf(StringType())
def _whole_characters(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Texts without their spans, each span drawn in to whole characters; null for those that have none."""
    out = []
    for text, own in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
        if text is None or not own:
            out.append(None)
            continue
        raw, kept, at = text.encode(), [], 0
        for s in own:
            a, b = min(s["a"], len(raw)), min(s["b"], len(raw))
            while a < b and raw[a] & 0xC0 == 0x80:
                a += 1
            while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                b -= 1
            kept.append(raw[at:a])
            at = b
        out.append(b"".join([*kept, raw[at:]]).decode())
    return pa.array(out, pa.string())


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages of 100 bytes or more that also start earlier in the corpus."""
    rows = numbered(docs)
    if rows is not None:
        return _cut_out(rows, "__row").drop("__row")
    return _cut_out(docs, "doc_id")


def _cut_out(docs: DataFrame, by: str) -> DataFrame:
    """without_repeats for docs whose rows differ in ``by``. Only texts that may lose something are shuffled."""
    ids = texts(docs, by)
    spans = suffix_dedup.repeated_spans(ids)
    found = sieve(spans.select("doc_id"))
    key = docs.withColumn("__id", F.coalesce(F.col(by), F.lit(NO_ID)))
    spans = spans.withColumnRenamed("doc_id", "__id")
    spans = spans.withColumnRenamed("spans", "__spans")
    changed = key.where(may(found, "__id")).join(spans, "__id", "left").withColumn("__kept", _whole_characters("text", "__spans"))
    new = {"text": F.coalesce("__kept", "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.length("__kept").cast(docs.schema["n_chars"].dataType), "n_chars")
    changed = changed.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])
    return changed if found is None else key.where(~may(found, "__id")).drop("__id").unionByName(changed)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("suffix-array dedup", without_repeats),
    ("packing", packed),
]
#: A trained classifier and merges learned elsewhere have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again, and goes once the next one stands."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), "stage")
        if before is not None:
            drop(before)
        before = docs
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
