"""CSV tables in and out; Parquet is the format between stages.

Text columns are never guessed into numbers or nulls: every CSV column is read
as text by its header name and cast where it is used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.text import strip
from postmill.functions.values import ISO_Z
from postmill.operators import checks
from postmill.plans.classify import (check_overrides, clean_overrides, prepare_overrides,
                                     review_problems)
from postmill.plans.skills import check_exclusions, clean_exclusions



def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, quoted line breaks and doubled quotes, all text."""
    return (spark.read.option("header", True).option("multiLine", True)
            .option("escape", '"').csv(path))


def read_csv_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """As read_csv; None when the path does not exist."""
    try:
        return read_csv(spark, path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def write_csv(df: DataFrame, path: str, order: Sequence[Column | str] = ()) -> None:
    """CSV with header and ISO times; sorted when an order is given.

    The order belongs to the delivered file, so it is applied here and not in
    the jobs that produce the table.
    """
    ordered = df.orderBy(*order) if order else df
    (ordered.write.mode("overwrite").option("header", True).option("escape", '"')
     .option("timestampFormat", ISO_Z).csv(path))


def write_with_subset(df: DataFrame, flag: Column, full: str, subset: str,
                      order: Sequence[Column | str] = ()) -> None:
    """The whole table and its flagged part.

    The part is cut from the written table, so the job behind `df` runs once.
    """
    ordered = df.orderBy(*order) if order else df
    ordered.write.mode("overwrite").parquet(full)
    written = df.sparkSession.read.parquet(full)
    part = written.filter(flag)
    (part.orderBy(*order) if order else part).write.mode("overwrite").parquet(subset)


# --- human tables ------------------------------------------------------------

def dictionary_problems(rows: DataFrame) -> DataFrame:
    """(problem, value): blank cells, repeated keys, names repeated up to case."""
    columns = ["skill_key", "skill_name", "skill_category", "aliases"]

    def tagged(df: DataFrame, problem: str, value: str) -> DataFrame:
        return df.select(F.lit(problem).alias("problem"), F.col(value).alias("value"))

    no_alias = rows.filter(strip(F.col("aliases")) != "").filter(
        F.size(F.filter(F.split("aliases", r"\|"), lambda a: strip(a) != "")) == 0)
    return (tagged(checks.blank_values(rows, columns), "blank value", "skill_key")
            .unionByName(tagged(checks.duplicate_keys(rows, ["skill_key"]), "repeated key",
                                "skill_key"))
            .unionByName(tagged(checks.duplicate_keys(rows, ["skill_name"], ignore_case=True),
                                "repeated name", "skill_name"))
            .unionByName(tagged(no_alias, "no alias", "skill_key")))


def load_skills(spark: SparkSession, path: str) -> DataFrame:
    """The dictionary as a table of any size, after its checks."""
    table = read_csv(spark, path)
    columns = ["skill_key", "skill_name", "skill_category", "aliases"]
    checks.require_columns(table, columns, "skill dictionary")
    rows = table.select(*[strip(F.col(c)).alias(c) for c in columns])
    checks.assert_empty(dictionary_problems(rows), "skill dictionary")
    return rows


def load_role_overrides(spark: SparkSession, path: str, default_source: str) -> DataFrame | None:
    table = read_csv_or_none(spark, path)
    return None if table is None else check_overrides(clean_overrides(table, default_source))


def load_skill_overrides(spark: SparkSession, path: str) -> DataFrame | None:
    table = read_csv_or_none(spark, path)
    return None if table is None else check_exclusions(clean_exclusions(table))


def load_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Override table made from a filled-in review file, after its checks."""
    audit = read_csv(spark, path)
    checks.assert_empty(review_problems(audit), "review table")
    return prepare_overrides(audit)
