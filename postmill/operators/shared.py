"""Tables that several steps of one job read, kept in the folder the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset a temporary folder serves, but only on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="postmill-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def settled(df: DataFrame, name: str) -> DataFrame:
    """`df` written once and read back, so that every reader sees the same rows and a lost
    executor costs none of the work before."""
    path = f"{shared_root(df.sparkSession)}/postmill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
