"""Session settings and small inline tables."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Correctness settings; sizes and parallelism stay with the cluster.
REQUIRED_CONF = {"spark.sql.session.timeZone": "UTC"}

LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    **REQUIRED_CONF,
}


def local_session(cpus: int = 8, **conf: str) -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName("postmill")
               .config("spark.driver.memory", "8g")
               .config("spark.sql.shuffle.partitions", str(cpus)))
    for key, value in {**LOCAL_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def inline_table(spark: SparkSession, columns: Sequence[str], rows: Sequence[Sequence]) -> DataFrame:
    """Table of strings known when the query is written.

    Built from Arrow it becomes a local relation of known size, which lets the
    planner decide on a broadcast by itself.
    """
    data = {c: pa.array([r[i] for r in rows], pa.string()) for i, c in enumerate(columns)}
    return spark.createDataFrame(pa.table(data))
