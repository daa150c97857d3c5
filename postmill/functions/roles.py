"""Title rules and review reasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.fixed import AMBIGUOUS_FAMILIES, NON_TARGET, RELEVANT_TITLE, ROLE_RULES
from postmill.functions.text import squash

Rules = Sequence[tuple[str, str]]


def with_rule_family(df: DataFrame, title: str, out: str, rules: Rules = ROLE_RULES,
                     default: str = NON_TARGET) -> DataFrame:
    """Add the family of the first rule whose pattern occurs in the title.

    The normalised title is its own column so that it is computed once, not
    once per rule; Catalyst keeps it apart because it is used many times.
    """
    key = F.col("_title_key")
    family = F.lit(None).cast("string")
    for name, pattern in reversed(list(rules)):
        family = F.when(key.rlike(f"(?U){pattern}"), name).otherwise(family)
    return (df.withColumn("_title_key", F.lower(squash(F.col(title))))
            .withColumn(out, F.coalesce(family, F.lit(default)))
            .drop("_title_key"))


def review_reason(family: Column, title: Column,
                  ambiguous: Sequence[str] = AMBIGUOUS_FAMILIES,
                  relevant: str = RELEVANT_TITLE) -> Column:
    """Why a classified posting deserves a second look; '' when it does not."""
    looks_relevant = F.coalesce(title, F.lit("")).rlike(f"(?U){relevant}")
    non_target = family == NON_TARGET
    return F.concat_ws(
        " | ",
        F.when(family.isin(*ambiguous), "Ambiguous standardized role"),
        F.when(non_target & looks_relevant, "Possible false negative"),
        F.when(~non_target & ~looks_relevant, "Possible false positive"))


def review_priority(reason: Column) -> Column:
    return (F.when(reason.contains("Possible false"), "High")
            .when(reason.contains("Ambiguous standardized role"), "Medium")
            .otherwise("No review"))
