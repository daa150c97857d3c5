"""Titles classified by a table of rules, thousands of them.

A rule names words one of which every title it fits must hold. Titles meet only the rules
that name one of their words, found by a join on words; the patterns are tried on those
titles alone, and of the rules that fit the one with the smallest number decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.fixed import NON_TARGET
from postmill.functions.text import squash
from postmill.operators import checks
from postmill.operators.skew import join_group_facts
from postmill.plans.classify import JOB_ID

RULE_COLUMNS = ("rule_no", "family", "pattern", "words")
# What a rule without required words is found by; every title has it.
ANY = ""


def rule_problems(rules: DataFrame) -> DataFrame:
    """(problem, rule_no): rules without number, family or pattern, and repeated numbers."""
    blank = checks.blank_values(rules, ["rule_no", "family", "pattern"]).select(
        F.lit("blank value").alias("problem"), F.col("rule_no").cast("string").alias("rule_no"))
    repeated = checks.duplicate_keys(rules, ["rule_no"]).select(
        F.lit("repeated number").alias("problem"), F.col("rule_no").cast("string").alias("rule_no"))
    return blank.unionByName(repeated)


def classify_by_table(jobs: DataFrame, rules: DataFrame, keys: Sequence[str] = JOB_ID,
                      title: str = "job_title_raw", default: str = NON_TARGET) -> DataFrame:
    """The keys of every job with its family and the number of the rule that decided.

    `rules` has (rule_no, family, pattern, words): patterns are matched against the squashed
    lower-case title as `functions.roles` does, `words` are in lower case, ASCII letters and
    digits; a rule without words is tried on every title. Words that very many titles hold
    are dealt over slices. Jobs are unique on `keys`; one that no rule fits has the default
    family and a null number.
    """
    checks.require_columns(rules, RULE_COLUMNS, "title rules")
    titles = jobs.select(*keys, F.lower(squash(F.col(title))).alias("_title"))
    held = F.array_distinct(F.concat(F.array(F.lit(ANY)), F.regexp_extract_all(
        "_title", F.lit("[a-z0-9]+"), 0)))
    words = F.coalesce("words", F.array().cast("array<string>"))
    named = rules.select("rule_no", "family", "pattern", F.explode(
        F.when(F.size(words) > 0, F.array_distinct(words)).otherwise(F.array(F.lit(ANY))))
        .alias("_word"))
    met = join_group_facts(titles.select("*", F.explode(held).alias("_word")), named, ["_word"],
                           keys)
    first = (met.filter(F.rlike("_title", F.concat(F.lit("(?U)"), "pattern")))
             .groupBy(*keys).agg(F.min(F.struct("rule_no", "family")).alias("_first")))
    return (titles.drop("_title").join(first, list(keys), "left")
            .select(*keys, F.coalesce("_first.family", F.lit(default)).alias("role_family"),
                    F.col("_first.rule_no").alias("rule_no")))
