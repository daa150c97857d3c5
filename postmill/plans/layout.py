"""Warehouse tables bucketed and sorted by job, so that star joins need no exchange.

Jobs and their skills are written with one number of buckets of the same key. A join of
the two, and a grouping of the skills by job, then finds equal keys in the same task
already. The tables live in the catalog, which is what remembers their layout.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from postmill.plans.views import KEY

# Tables that share the layout; the others are dictionary-sized.
BY_JOB = ("jobs", "job_skills")
BUCKETS = 64


def table_name(database: str, name: str, run_id: str) -> str:
    return f"{database}.{name}_{run_id.replace('-', '')}"


def write_bucketed(tables: Mapping[str, DataFrame], database: str, run_id: str, folder: str,
                   buckets: int = BUCKETS) -> list[str]:
    """Write the tables of a build into the catalog; returns their names.

    Rows are brought to their bucket first, so a bucket is one sorted file. Let a bucket
    be a few hundred megabytes: `buckets` is for the caller to size, and both tables of
    all builds to be joined need the same. A build that exists is an error.
    """
    names = []
    for name, df in tables.items():
        writer = (df.repartition(buckets, KEY).write.bucketBy(buckets, KEY).sortBy(KEY)
                  if name in BY_JOB else df.write)
        names.append(table_name(database, name, run_id))
        writer.format("parquet").option("path", f"{folder}/bucketed/{name}").saveAsTable(names[-1])
    return names


def read_bucketed(spark: SparkSession, database: str, run_id: str,
                  names: tuple[str, ...]) -> dict[str, DataFrame]:
    return {n: spark.table(table_name(database, n, run_id)) for n in names}
