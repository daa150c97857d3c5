"""Warehouse: check, write, check again, then publish.

Tables are written under `<root>/builds/<run id>`. A build exists for readers
only once its row stands in `<root>/pipeline_runs`, which is appended last;
a lost job leaves files nobody reads. Nothing published is overwritten.

Beside the four tables a build holds `job_baskets`, jobs joined with their
skills and laid out by role: the views and the gap queries read it, so a
question about one role reads that role's files and shuffles almost nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from postmill.fixed import (BRIDGE_COLUMNS, MASTER_COLUMNS, MASTER_LAYOUT, RUN_COLUMNS,
                            SKILL_COLUMNS, VIEW_NAMES)
from postmill.functions.text import blank_to_null
from postmill.functions.values import strict_bool
from postmill.operators import checks
from postmill.plans import layout, versions
from postmill.plans.views import KEY, job_baskets, register_views, view_frames

TABLES = ("sources", "jobs", "skills", "job_skills")
# Stated, because partition values such as '2024' would otherwise be guessed.
LOADED_AT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
BASKET_SCHEMA = f"{KEY} string, skills array<string>, role_family string"


def source_dimension(jobs: DataFrame) -> DataFrame:
    return (jobs.select(blank_to_null(F.col("source")).alias("source"))
            .filter(F.col("source").isNotNull()).distinct())


def warehouse_jobs(jobs: DataFrame) -> DataFrame:
    """Blank text becomes null, booleans are read strictly, numbers cast strictly."""
    have = dict(jobs.dtypes)

    def load(name: str, kind: str) -> Column:
        column = F.col(name)
        if have[name] == kind and kind != "string":
            return column
        if kind == "string":
            return blank_to_null(column).alias(name)
        if kind == "boolean":
            return strict_bool(column).alias(name)
        return blank_to_null(column).cast(kind).alias(name)

    return jobs.select(*[load(n, k) for n, k in MASTER_LAYOUT])


def warehouse_skills(skills: DataFrame) -> DataFrame:
    return skills.select(*[blank_to_null(F.col(c)).alias(c) for c in SKILL_COLUMNS])


def warehouse_bridge(bridge: DataFrame) -> DataFrame:
    texts = [blank_to_null(F.col(c)).alias(c) for c in BRIDGE_COLUMNS[:-1]]
    return bridge.select(*texts, F.col("evidence_field_count").cast("int")
                         .alias("evidence_field_count"))


def table_rules() -> dict[str, dict[str, Column]]:
    """Row constraints of each table."""
    def present(*columns: str) -> dict[str, Column]:
        return {f"{c} present": F.col(c).isNotNull() for c in columns}

    return {
        "jobs": {**present(KEY, "source", "source_job_id", "job_title_raw", "role_family",
                           "is_target_data_role"),
                 "only target rows": F.col("is_target_data_role"),
                 "salary range": F.coalesce(F.col("salary_min") <= F.col("salary_max"),
                                            F.lit(True))},
        "skills": present(*SKILL_COLUMNS),
        "job_skills": {**present(KEY, "skill_key"),
                       "evidence counted": F.col("evidence_field_count") >= 1},
        "sources": present("source"),
    }


def check_tables(tables: Mapping[str, DataFrame]) -> None:
    """Layout, row rules, unique keys and references; raises on the first failure."""
    jobs, skills, bridge = tables["jobs"], tables["skills"], tables["job_skills"]
    for name, columns in (("jobs", MASTER_COLUMNS), ("skills", SKILL_COLUMNS),
                          ("job_skills", BRIDGE_COLUMNS)):
        checks.require_layout(tables[name], columns, name)
    rules = table_rules()
    for name, df in tables.items():
        checks.assert_empty(checks.rule_failures(df, rules[name]).filter("failing_rows > 0"), name)
    for name, keys in (("jobs", [KEY]), ("skills", ["skill_key"]),
                       ("job_skills", [KEY, "skill_key"])):
        checks.one_row_per_key(tables[name], keys, name)
    checks.assert_empty(checks.orphans(bridge, jobs, KEY, KEY), "unknown job keys")
    checks.assert_empty(checks.orphans(bridge, skills, "skill_key", "skill_key"),
                        "unknown skill keys")


def publish(spark: SparkSession, root: str, jobs: DataFrame, skills: DataFrame,
            bridge: DataFrame, database: str | None = None,
            buckets: int = layout.BUCKETS) -> str:
    """Build, verify and publish a warehouse; returns the run id.

    Inputs are converted and written once; the checks run on the written
    tables, so nothing upstream is computed twice. With a `database` of the
    catalog the build is also written bucketed by job, and published as the
    version after the one that was newest when the work began: views that
    outlive the session follow it, and of two publishers at once one fails.
    """
    known = versions.newest_version(spark, root) if database else 0
    for df, columns, name in ((jobs, MASTER_COLUMNS, "jobs"), (skills, SKILL_COLUMNS, "skills"),
                              (bridge, BRIDGE_COLUMNS, "job_skills")):
        checks.require_layout(df, columns, name)
    run_id = str(uuid.uuid4())
    folder = f"{root}/builds/{run_id}"
    received = {
        "jobs": _load(warehouse_jobs(jobs), f"{folder}/jobs"),
        "skills": _load(warehouse_skills(skills), f"{folder}/skills"),
        "job_skills": _load(warehouse_bridge(bridge), f"{folder}/job_skills")}
    received["sources"] = _load(source_dimension(spark.read.parquet(f"{folder}/jobs")),
                                f"{folder}/sources")

    tables = read_build(spark, root, run_id)
    expected = spark.createDataFrame(list(received.items()), "table_name string, table_rows long")
    checks.assert_empty(checks.count_mismatch(checks.table_counts(tables), expected),
                        "written and received row counts differ")
    check_tables(tables)
    checks.assert_empty(checks.dimension_mismatch(tables["sources"], "source", tables["jobs"],
                                                  "source"), "sources do not match jobs")
    # A role's rows come together first, in parts of a size that suits a file.
    (job_baskets(tables["jobs"], tables["job_skills"]).hint("rebalance", "role_family")
     .write.partitionBy("role_family").parquet(f"{folder}/job_baskets"))
    run = run_row(tables, run_id)
    baskets = read_baskets(spark, root, run_id)
    if database:
        layout.write_bucketed(tables, database, run_id, folder, buckets)
        versions.publish_version(spark, root, database, run_id, known,
                                 view_frames(tables["jobs"], tables["skills"], baskets))
    run.write.mode("append").parquet(f"{root}/pipeline_runs")
    register(spark, tables, baskets)
    missing = checks.missing_views(spark, VIEW_NAMES)
    if missing:
        raise checks.CheckFailed(f"views not published: {missing}")
    return run_id


def _load(df: DataFrame, path: str) -> int:
    """Write a table and return how many rows went in, counted while writing."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return seen.get["rows"]


def run_row(tables: Mapping[str, DataFrame], run_id: str) -> DataFrame:
    """The audit row of a build: its id, load time and row counts."""
    counts = checks.table_counts({t: tables[t] for t in TABLES})
    per_table = {t: F.sum(F.when(F.col("table_name") == t, F.col("table_rows"))) for t in TABLES}
    return (counts.agg(*[c.alias(f"{t}_loaded") for t, c in per_table.items()])
            .select(F.lit(run_id).alias("run_id"),
                    # Microseconds, so that of two builds in one second the later one wins.
                    F.date_format(F.current_timestamp(), LOADED_AT).alias("loaded_at"),
                    *RUN_COLUMNS[2:])
            .coalesce(1))


def runs(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/pipeline_runs")


def latest_of(run_rows: DataFrame) -> DataFrame:
    """The row of the last run; of equal load times the greater id wins."""
    return run_rows.orderBy(F.desc("loaded_at"), F.desc("run_id")).limit(1)


def latest_run(spark: SparkSession, root: str) -> DataFrame:
    return latest_of(runs(spark, root))


def read_build(spark: SparkSession, root: str, run_id: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{root}/builds/{run_id}/{t}") for t in TABLES}


def read_baskets(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    return spark.read.schema(BASKET_SCHEMA).parquet(f"{root}/builds/{run_id}/job_baskets")


def latest_id(spark: SparkSession, root: str) -> str:
    return latest_run(spark, root).first()["run_id"]


def read_latest(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return read_build(spark, root, latest_id(spark, root))


def register(spark: SparkSession, tables: Mapping[str, DataFrame],
             baskets: DataFrame | None = None) -> None:
    """Tables and the six views for use from SQL."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    register_views(spark, tables["jobs"], tables["skills"],
                   tables["job_skills"] if baskets is None else baskets)


def run_mismatch(spark: SparkSession, root: str) -> DataFrame:
    """Tables of the latest build whose counts differ from its audit row."""
    return row_mismatch(latest_run(spark, root), read_latest(spark, root))


def row_mismatch(row: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Tables whose counts differ from those that a run's row states."""
    pairs = ", ".join(f"struct('{t}' as table_name, {t}_loaded as table_rows)" for t in TABLES)
    return checks.count_mismatch(checks.table_counts(tables),
                                 row.selectExpr(f"inline(array({pairs}))"))
