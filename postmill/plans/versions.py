"""Versions of a published warehouse and the persistent views over the current one.

A version is a number and the build it stands for. The number is claimed by creating a
table of that name in the catalog, which lets one publisher succeed and fails all others;
then the version's row is appended, and with that one file the views, which look the
newest version up when they are read, show the new build, all of them at once.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION_SCHEMA = "version int, run_id string"
TAKEN = "TABLE_OR_VIEW_ALREADY_EXISTS"


class VersionTaken(RuntimeError):
    """Another publisher has this version; read the newest one and decide anew."""


def versions(spark: SparkSession, root: str) -> DataFrame:
    """(version, run_id) of all that were published."""
    try:
        return spark.read.schema(VERSION_SCHEMA).parquet(f"{root}/versions")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], VERSION_SCHEMA)


def newest_version(spark: SparkSession, root: str) -> int:
    """0 where nothing is published."""
    return versions(spark, root).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


def _claim_name(database: str, version: int) -> str:
    return f"{database}.claim_v{version:06d}"


def claim(spark: SparkSession, database: str, version: int, run_id: str) -> None:
    """Take a version number; raises VersionTaken if another run has it."""
    try:
        spark.sql(f"CREATE TABLE {_claim_name(database, version)} (run_id string) USING parquet "
                  f"COMMENT 'claimed by {run_id}'")
    except AnalysisException as e:
        if e.getCondition() == TAKEN:
            raise VersionTaken(f"version {version} is taken") from e
        raise


def release(spark: SparkSession, root: str, database: str, version: int) -> None:
    """Give back a claim whose publisher died before it published; never a published one."""
    if not versions(spark, root).filter(F.col("version") == version).isEmpty():
        raise ValueError(f"version {version} is published")
    spark.sql(f"DROP TABLE IF EXISTS {_claim_name(database, version)}")


def write_view_rows(views: Mapping[str, DataFrame], root: str, run_id: str) -> None:
    """The rows of every view of one build, beside those of the others."""
    for name, df in views.items():
        df.write.parquet(f"{root}/views/{name}/run_id={run_id}")


def publish_version(spark: SparkSession, root: str, database: str, run_id: str, after: int,
                    views: Mapping[str, DataFrame]) -> int:
    """Publish a build as the version that follows `after`, the newest the publisher knew.

    Of publishers that start from the same version one wins; the others get VersionTaken
    and have changed nothing that readers see. Returns the new version.
    """
    if newest_version(spark, root) != after:
        raise VersionTaken(f"version {after} is not the newest any more")
    claim(spark, database, after + 1, run_id)
    write_view_rows(views, root, run_id)
    row = spark.createDataFrame([(after + 1, run_id)], VERSION_SCHEMA).coalesce(1)
    row.write.mode("append").parquet(f"{root}/versions")
    create_views(spark, root, database, {n: df.columns for n, df in views.items()})
    return after + 1


def create_views(spark: SparkSession, root: str, database: str,
                 views: Mapping[str, list[str]]) -> None:
    """Persistent views in the catalog; they follow the newest version by themselves."""
    newest = f"(SELECT max_by(run_id, version) FROM parquet.`{root}/versions`)"
    for name, columns in views.items():
        listed = ", ".join(f"`{c}`" for c in columns)
        spark.sql(f"CREATE OR REPLACE VIEW {database}.{name} AS SELECT {listed} "
                  f"FROM parquet.`{root}/views/{name}` WHERE run_id = {newest}")


def expired(published: DataFrame, keep: int) -> DataFrame:
    """The versions that are not among the newest `keep`."""
    if keep < 1:
        raise ValueError("the newest version is always kept")
    newest = published.agg(F.max("version")).scalar()
    return published.filter(F.col("version") <= newest - keep)


def remove_expired(spark: SparkSession, root: str, keep: int) -> list[str]:
    """Delete the files of builds beyond the newest `keep` versions; returns their run ids.

    Only published builds go: one that is being written is not among them. The version
    rows stay, as the record of what there was.
    """
    names = sorted(n for n in versions(spark, root).columns)
    gone = [r.run_id for r in expired(versions(spark, root), keep).select(*names).collect()]
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    view_root = jvm.org.apache.hadoop.fs.Path(f"{root}/views")
    files = view_root.getFileSystem(conf)
    held = [s.getPath().toString() for s in files.listStatus(view_root)] if files.exists(view_root) else []
    for run_id in gone:
        for folder in (f"{root}/builds/{run_id}", *(f"{v}/run_id={run_id}" for v in held)):
            files.delete(jvm.org.apache.hadoop.fs.Path(folder), True)
    return gone
