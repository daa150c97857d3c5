"""Conforming sources into one posting table, and its two reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.fixed import MASTER_LAYOUT, OPTIONAL_COLUMNS
from postmill.functions.text import is_blank, strip
from postmill.functions.values import loose_bool, parse_iso, to_number
from postmill.operators import checks
from postmill.operators.skew import SLICES, join_group_facts

REQUIRED = tuple(name for name, _ in MASTER_LAYOUT[1:] if name not in OPTIONAL_COLUMNS)


def conform(staged: DataFrame) -> DataFrame:
    """One source in the master layout; absent optional columns become null."""
    checks.require_columns(staged, REQUIRED, "staged source")
    kinds = dict(MASTER_LAYOUT)
    full = checks.with_optional(staged, {c: kinds[c] for c in OPTIONAL_COLUMNS})
    full = full.withColumns({c: strip(F.col(c)) for c in ("source", "source_job_id")})
    full = full.withColumn("source_record_key",
                           checks.record_key(F.col("source"), F.col("source_job_id")))
    have = dict(full.dtypes)

    def convert(name: str, kind: str):
        column = F.col(name)
        if have[name] == kind:
            return column
        if kind == "boolean":
            return loose_bool(column).alias(name)
        if kind == "timestamp":
            return parse_iso(column).alias(name)
        if kind == "double":
            return to_number(column).alias(name)
        return column.cast(kind).alias(name)

    return full.select(*[convert(n, k) for n, k in MASTER_LAYOUT])


def check_source(staged: DataFrame, expected: str) -> DataFrame:
    """Fail unless the table holds the expected source and every row has an id."""
    checks.require_columns(staged, REQUIRED, expected)
    checks.assert_empty(checks.wrong_source(staged, expected), f"{expected}: wrong source")
    checks.assert_empty(checks.blank_values(staged, ["source_job_id"]).select("source"),
                        f"{expected}: rows without source_job_id")
    return staged


def build_master(sources: Mapping[str, DataFrame], verify: bool = True) -> DataFrame:
    """Union of the conformed sources, unique on source_record_key.

    With `verify` the source names, ids and keys are checked by their own jobs
    first, as a loader should; a query that only needs the rows can skip that.
    """
    parts = [conform(check_source(df, name) if verify else df) for name, df in sources.items()]
    master = parts[0]
    for part in parts[1:]:
        master = master.unionByName(part)
    if verify:
        checks.one_row_per_key(master, ["source_record_key"], "master")
    return master


def target_rows(master: DataFrame) -> DataFrame:
    return master.filter(F.coalesce("is_target_data_role", F.lit(False)))


def master_order() -> list:
    """Order of the master file: newest first, then source, title and key."""
    return [F.col("publication_date").desc_nulls_last(), F.col("source").asc_nulls_last(),
            F.col("job_title_raw").asc_nulls_last(), F.col("source_record_key")]


DUPLICATE_COLUMNS = ("duplicate_scope", "job_fingerprint", "record_count", "source_count",
                     "source", "source_job_id", "company_name", "job_title_raw", "location_raw",
                     "publication_date", "job_url")


def duplicate_candidates(master: DataFrame, slices: int = SLICES) -> DataFrame:
    """Every posting that shares its fingerprint with another one.

    Group facts come from an aggregation, not a window, and reach the rows by
    a join in `slices` parts: one fingerprint may hold any share of all rows, and a
    group is spread over as many tasks at most. The master is read for the facts, the slices and the rows; hand over a written one.
    """
    marked = master.filter(~is_blank(F.col("job_fingerprint")))
    groups = (marked.groupBy("job_fingerprint")
              .agg(F.count("*").alias("record_count"),
                   F.count_distinct("source").alias("source_count"))
              .filter("record_count > 1"))
    scope = F.when(F.col("source_count") > 1, "Cross-source").otherwise("Within-source")
    return (join_group_facts(marked, groups, ["job_fingerprint"],
                             ["source", "source_job_id"], slices)
            .withColumn("duplicate_scope", scope).select(*DUPLICATE_COLUMNS))


def duplicate_order() -> list:
    """The id closes the key, so equal fingerprints can be cut between tasks."""
    return [F.col(c) for c in ("duplicate_scope", "job_fingerprint", "source", "source_job_id")]


def duplicate_groups(master: DataFrame) -> DataFrame:
    """(duplicate_scope, duplicate_groups, duplicate_records)."""
    groups = (master.filter(~is_blank(F.col("job_fingerprint"))).groupBy("job_fingerprint")
              .agg(F.count("*").alias("n"), F.count_distinct("source").alias("s"))
              .filter("n > 1"))
    scope = F.when(F.col("s") > 1, "Cross-source").otherwise("Within-source")
    return (groups.groupBy(scope.alias("duplicate_scope"))
            .agg(F.count("*").alias("duplicate_groups"), F.sum("n").alias("duplicate_records")))


def source_reconciliation(master: DataFrame) -> DataFrame:
    """Record counts and completeness per source, in one pass."""
    target = F.coalesce("is_target_data_role", F.lit(False))
    override = F.coalesce("role_override_applied", F.lit(False))
    no_salary = is_blank(F.col("salary_raw"))
    return master.groupBy("source").agg(
        F.count("*").alias("total_records"),
        F.count_if(target).alias("target_roles"),
        F.count_if(~target).alias("non_target_roles"),
        F.count_if(override).alias("overrides_applied"),
        F.count_if(~no_salary).alias("salary_disclosed"),
        F.count_if(no_salary).alias("missing_salary"),
        F.count_if(F.col("publication_date").isNull()).alias("missing_publication_dates"))
