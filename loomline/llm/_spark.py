"""What the operators share: the shared folder, written intermediate tables, table reading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local master may fall back to a temporary one."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.conf.set("spark.checkpoint.dir", found := "file://" + tempfile.mkdtemp(prefix="spark-"))
    return found


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    Lineage ends there, so a lost executor costs no recomputation, and a join against the reread table
    has an exchange on both sides, which is what adaptive execution needs to split a skewed key.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomline/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # the plan runs once, so its shuffle files may go as soon as it has ended
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    return out


def drop(*stashed: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in stashed:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stashed_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
READ = "spark.sql.parquet.columnarReaderBatchSize"


def modest(spark: SparkSession) -> None:
    """Rows that go to a Python worker, and that are read, at once: about a tenth of Spark's own numbers, unless the session has set one, as a row here is a whole text."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "1000")
    if spark.conf.get(READ) == "4096":
        spark.conf.set(READ, "512")


#: Stands for a null id inside the operators, so that it comes after all others; results have null again.
NO_ID = (1 << 63) - 1


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) alone, null texts as empty and null ids as NO_ID: other columns never reach a Python worker."""
    modest(docs.sparkSession)
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def numbered(docs: DataFrame, id_col: str = "doc_id", then: Column | None = None, name: str = "__row") -> DataFrame | None:
    """docs with a number of its own for each row, in the order of (id, ``then``, by default a digest of the text), or None if no two rows share an id.

    Null ids count as one id and come last. Rows alike in both follow one another in any order; the random third key
    only spreads them.
    """
    if docs.groupBy(id_col).count().where("count > 1").isEmpty():
        return None
    rows = docs.orderBy(F.col(id_col).asc_nulls_last(), F.md5(F.coalesce(F.col("text"), F.lit(""))) if then is None else then, F.rand(1))
    return stash(rows.withColumn(name, F.monotonically_increasing_id()), "rows")


def with_nulls(df: DataFrame, *ids: str) -> DataFrame:
    """df with null for NO_ID in its id columns."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit(NO_ID)) for c in ids or ("doc_id",)})


def parts_for(rows: int, each: int) -> int:
    return max(1, -(-int(rows) // each))
