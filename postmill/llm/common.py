"""What several operators share: input columns, shared folders, held-out folds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def id_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only ``doc_id`` and ``text`` (null text: empty), so that other columns, whatever
    their names, cannot clash with what an operator adds."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def shared_root(spark: SparkSession) -> str:
    """The folder all executors and the driver share, from ``spark.checkpoint.dir``.

    Unset, a temporary folder serves, but only where driver and executors are one
    process; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="postmill-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/postmill/{name}-{uuid.uuid4().hex}"


#: Whether a query's shuffle files go when it has ended, not when the driver happens to
#: collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written to the shared folder and read again: its lineage ends there, and a
    lost executor costs no recomputation of what came before."""
    conf, path = df.sparkSession.conf, shared_path(df.sparkSession, name)
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id falls in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0)) % folds


def hash_sample(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """At most ``rows`` rows, those with the smallest hash of the first key, the same ones on
    every run. Rows that cannot be among them stay where they are: a cut at about the
    right hash comes before the order, so tasks do not each send ``rows`` rows."""
    place = F.pmod(F.xxhash64(keys[0]), F.lit(1 << 31))
    n = df.count()
    if n > rows:
        df = df.filter(place < int(min(1.0, 1.25 * rows / n + 100 / n) * (1 << 31)))
    return df.orderBy(place, *keys).limit(rows)
