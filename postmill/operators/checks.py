"""Data-quality checks.

A check returns the offending rows or keys, so an empty result is a pass;
`assert_empty` turns a failure into an error. Checks on column names read
metadata only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.text import is_blank, strip
from postmill.operators.compare import dimension_mismatch, duplicate_keys, set_difference

__all__ = ["dimension_mismatch", "duplicate_keys", "set_difference"]  # checks from elsewhere


class CheckFailed(ValueError):
    """A data-quality check found offenders."""


def assert_empty(violations: DataFrame, message: str, show: int = 20) -> None:
    """Raise with a few sample offenders; the full set stays distributed."""
    sample = violations.limit(show).collect()
    if sample:
        raise CheckFailed(f"{message}: {[r.asDict() for r in sample]}")


def assert_some(df: DataFrame, message: str) -> None:
    if df.isEmpty():
        raise CheckFailed(message)


# --- schema ------------------------------------------------------------------

def require_columns(df: DataFrame, required: Sequence[str], name: str) -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise CheckFailed(f"{name} lacks columns {missing}")


def require_layout(df: DataFrame, expected: Sequence[str], name: str) -> None:
    if list(df.columns) != list(expected):
        raise CheckFailed(f"{name} has columns {df.columns}, expected {list(expected)}")


def with_optional(df: DataFrame, optional: Mapping[str, str]) -> DataFrame:
    """Add absent optional columns as typed nulls."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in optional.items()
                           if c not in df.columns})


def missing_names(expected: DataFrame, present: DataFrame, name: str) -> DataFrame:
    """Names that are expected and not there, each once."""
    wanted = expected.select(name).filter(F.col(name).isNotNull()).distinct()
    return wanted.join(present.select(name), name, "left_anti")


def missing_views(spark: SparkSession, expected: Sequence[str]) -> list[str]:
    return sorted(v for v in expected if not spark.catalog.tableExists(v))


# --- keys --------------------------------------------------------------------

def blank_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a null or blank value in any of the columns."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | is_blank(F.col(c))
    return df.filter(bad)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child keys without a parent, null keys ignored, with their row counts.

    Children are counted per key first, so a key held by very many rows
    crosses the shuffle once per task.
    """
    keys = (child.filter(F.col(child_key).isNotNull())
            .groupBy(child_key).agg(F.count("*").alias("child_rows")))
    parents = parent.select(F.col(parent_key).alias(child_key))
    return keys.join(parents, child_key, "left_anti")


def malformed_keys(df: DataFrame, key: str = "source_record_key", source: str = "source",
                   local_id: str = "source_job_id") -> DataFrame:
    """Rows whose stored key differs from the rebuilt one."""
    return df.filter(~F.col(key).eqNullSafe(record_key(F.col(source), F.col(local_id))))


def record_key(source: Column, local_id: Column) -> Column:
    return F.concat(F.lower(strip(source)), F.lit("::"), strip(local_id))


# --- values ------------------------------------------------------------------

def wrong_source(df: DataFrame, expected: str, column: str = "source") -> DataFrame:
    """Source names other than the expected one; an empty table is a violation."""
    names = df.groupBy(strip(F.col(column)).alias(column)).agg(F.count("*").alias("source_rows"))
    found = names.agg(F.count_if(F.col(column) == expected).alias("source_rows"))
    absent = found.filter("source_rows = 0").select(F.lit(None).cast("string").alias(column),
                                                    "source_rows")
    return names.filter(F.col(column) != expected).unionByName(absent)


def outside_domain(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Values not in the allowed list, with their row counts."""
    return (df.filter(~F.coalesce(F.col(column), F.lit("")).isin(*allowed))
            .groupBy(column).agg(F.count("*").alias("value_rows")))


def inverted_range(df: DataFrame, low: str, high: str) -> DataFrame:
    return df.filter(F.col(low) > F.col(high))


def not_true(df: DataFrame, flag: str) -> DataFrame:
    return df.filter(~F.coalesce(F.col(flag), F.lit(False)))


def flag_mismatch(df: DataFrame, flag: str, truth: Column) -> DataFrame:
    return df.filter(~F.col(flag).eqNullSafe(truth))


def rule_failures(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, failing_rows) for row rules, all in one scan; null counts as failing."""
    counts = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(f"r{i}")
                      for i, ok in enumerate(rules.values())])
    pairs = ", ".join(f"struct('{name}' as rule, r{i} as failing_rows)"
                      for i, name in enumerate(rules))
    return counts.selectExpr(f"inline(array({pairs}))")


def completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, missing_rows, total_rows) with null or blank as missing, in one scan."""
    counts = df.agg(F.count("*").alias("n"),
                    *[F.count_if(is_blank(F.col(c))).alias(f"m{i}") for i, c in enumerate(columns)])
    rows = ", ".join(f"struct('{c}' as column_name, m{i} as missing_rows, n as total_rows)"
                     for i, c in enumerate(columns))
    return counts.selectExpr(f"inline(array({rows}))")


# --- between tables ----------------------------------------------------------

def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, table_rows), one row per table."""
    parts = [df.agg(F.count("*").alias("table_rows")).select(F.lit(n).alias("table_name"),
                                                             "table_rows")
             for n, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def count_mismatch(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Tables of two `table_counts` results whose counts differ or that lack a partner."""
    wanted = expected.withColumnRenamed("table_rows", "expected_rows")
    return (actual.join(wanted, "table_name", "full")
            .filter(~F.col("table_rows").eqNullSafe(F.col("expected_rows"))))


def one_row_per_key(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Assert that `df` has one row per key, and return it."""
    assert_empty(duplicate_keys(df, keys), f"{name} has repeated join keys")
    return df


def unmatched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right.select(*keys), list(keys), "left_anti")
