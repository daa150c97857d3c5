"""Exact dedup as a streaming aggregation with disk-backed keyed state.

Each document's digest lands in a narrow table. A stream reads that table; its state
(RocksDB, no watermark, so no expiry) keeps per digest the stable identifier (largest id),
the locator of the content to compare with (smallest id) and the number of rows. Partial
aggregation runs before the shuffle, so a digest that a third of all rows share arrives
as one row per task. Digests with more than one row are hits: their full texts are
compared. Should two texts share a digest, their rows are grouped again by the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.common import id_text, shared_path, written

#: Rows of one digest are compared in so many slices at least side by side.
SLICES = 16
#: How much of the landed digests one micro-batch takes.
BYTES_PER_BATCH = 16 << 30

STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # Many small stores: no megabytes of disk set aside for the log of each.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def digest(text: Column, bits: int = 256) -> Column:
    """SHA-256 in lowercase hex, cut to its first ``bits`` (a multiple of 4)."""
    return F.substring(F.sha2(text, 256), 1, bits // 4)


def digest_state(landed: DataFrame, path: str, bytes_per_batch: int = BYTES_PER_BATCH) -> DataFrame:
    """digest, keep_id, locator, group_size: the state after all of ``landed``, a table
    written at ``path``."""
    spark = landed.sparkSession
    out, log = shared_path(spark, "digests"), shared_path(spark, "digest-log")
    session: SparkSession = spark.newSession()
    for key, value in {**STATE, "spark.sql.session.timeZone": spark.conf.get("spark.sql.session.timeZone"),
                       "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions")}.items():
        session.conf.set(key, value)

    def keep(batch: DataFrame, number: int) -> None:
        # A batch that runs again after a failure replaces what it wrote before.
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/n={number}")

    (session.readStream.schema(landed.schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(path)
     .groupBy("digest")
     .agg(F.max("doc_id").alias("keep_id"), F.min("doc_id").alias("locator"),
          F.count(F.lit(1)).alias("group_size"))
     .writeStream.outputMode("update").option("checkpointLocation", log)
     .trigger(availableNow=True).foreachBatch(keep).start().awaitTermination())
    ids = landed.schema["doc_id"].dataType.simpleString()
    schema = f"digest string, keep_id {ids}, locator {ids}, group_size bigint, batch int, n int"
    seen = spark.read.schema(schema).parquet(out)
    # A digest is written by every batch that changed it; the last one counts.
    return (seen.groupBy("digest")
            .agg(F.max(F.struct("batch", "keep_id", "locator", "group_size")).alias("s"))
            .select("digest", "s.keep_id", "s.locator", "s.group_size"))


def clashing(rows: DataFrame, groups: DataFrame, slices: int = SLICES) -> DataFrame:
    """digest: those of hits whose full texts are not all the same bytes."""
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(slices)).cast("int")
    hits = (groups.filter("group_size > 1")
            .select("digest", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("salt")))
    return (rows.withColumn("salt", salt).join(hits, ["digest", "salt"])
            .groupBy("digest", "salt").agg(F.min("text").alias("lo"), F.max("text").alias("hi"))
            .groupBy("digest").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
            .filter("lo <> hi").select("digest"))


def exact_dedup(docs: DataFrame, bits: int = 256, bytes_per_batch: int = BYTES_PER_BATCH) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``.

    Of equal texts the row with the largest id stays. Null texts count as empty, and
    empty texts equal one another. A null id never stays unless its whole group has none
    (then keep_id is null and kept is true). Rows that repeat the staying id and its text
    are all kept. An empty table gives an empty result; other columns take no part.
    """
    spark = docs.sparkSession
    rows = id_text(docs).withColumn("digest", digest(F.col("text"), bits))
    path = shared_path(spark, "landed")
    rows.select("doc_id", "digest", F.sha2("text", 256).alias("text_sha256")).write.parquet(path)
    landed = spark.read.schema(rows.select(
        "doc_id", "digest", F.lit("").alias("text_sha256")).schema).parquet(path)
    groups = written(digest_state(landed, path, bytes_per_batch), "groups")
    clashes = written(clashing(rows, groups), "clashes")
    result = landed.join(groups, "digest")
    if not clashes.isEmpty():
        again = (rows.join(clashes, "digest").groupBy("digest", "text")
                 .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
                 .select(F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"))
        result = (result.join(clashes, "digest", "left_anti")
                  .select("doc_id", "text_sha256", "keep_id", "group_size")
                  .unionByName(landed.join(clashes, "digest", "left_semi").join(again, "text_sha256")
                               .select("doc_id", "text_sha256", "keep_id", "group_size")))
    return result.select("doc_id", "keep_id", "group_size",
                         F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
