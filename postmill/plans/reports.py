"""Summary pages: market figures, role explorer, associations, load summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.fixed import CONFIDENT_SAMPLE, MODERATE_SAMPLE
from postmill.functions.values import percent, ratio
from postmill.operators.dedup import top_rows
from postmill.plans.associations import associations
from postmill.plans.views import (as_bridge, role_skill_cooccurrence, role_skill_demand,
                                  role_summary, row_total, salary_by_role, skill_baskets,
                                  skill_cooccurrence)


def sample_confidence(postings: Column) -> Column:
    return (F.when(postings >= CONFIDENT_SAMPLE, "Higher confidence")
            .when(postings >= MODERATE_SAMPLE, "Moderate confidence")
            .otherwise("Limited confidence"))


def market_kpis(jobs: DataFrame, skills: DataFrame, bridge: DataFrame) -> DataFrame:
    """Headline figures in one row."""
    covered = (skill_baskets(bridge).select(F.size("skills").cast("long").alias("n"))
               .filter("n > 0"))
    links = covered.agg(F.sum("n").alias("links"), F.count("*").alias("covered"))
    return (links.select(
                row_total(jobs).alias("postings"),
                jobs.agg(F.count_distinct("company_name").alias("n")).scalar().alias("companies"),
                row_total(skills).alias("skills_tracked"),
                F.coalesce("links", F.lit(0)).alias("relationships"),
                F.col("covered").alias("jobs_with_skills"))
            .withColumns({
                "coverage_pct": percent(F.col("jobs_with_skills"), F.col("postings")),
                "avg_skills_per_job": F.round(ratio(F.col("relationships"), F.col("postings")), 2)}))


def role_overview(jobs: DataFrame) -> DataFrame:
    """Per role: postings, companies, share and sample confidence."""
    return role_summary(jobs).withColumn("sample_confidence",
                                         sample_confidence(F.col("job_count")))


def role_top_skills(jobs: DataFrame, skills: DataFrame, bridge: DataFrame, k: int) -> DataFrame:
    order = [F.desc("skill_job_count"), F.asc("skill_key")]
    return top_rows(role_skill_demand(jobs, skills, bridge), ["role_family"], order, k)


def role_top_pairs(jobs: DataFrame, skills: DataFrame, bridge: DataFrame, k: int) -> DataFrame:
    order = [F.desc("cooccurrence_jobs"), F.asc("skill_1_key"), F.asc("skill_2_key")]
    return top_rows(role_skill_cooccurrence(jobs, skills, bridge), ["role_family"], order, k)


def frequent_pairs(jobs: DataFrame, skills: DataFrame, bridge: DataFrame, k: int) -> DataFrame:
    """The pairs most postings share."""
    return (skill_cooccurrence(jobs, skills, bridge)
            .orderBy(F.desc("cooccurrence_jobs"), "skill_1_key", "skill_2_key").limit(k))


def strong_associations(jobs: DataFrame, skills: DataFrame, bridge: DataFrame,
                        min_support: int, k: int) -> DataFrame:
    """The pairs with the highest lift among those with enough postings."""
    return (associations(jobs, skills, bridge, min_support)
            .orderBy(F.desc("lift"), F.desc("cooccurrence_jobs"), "skill_1_key", "skill_2_key")
            .limit(k))


def comparable_salaries(jobs: DataFrame, currency: str, period: str) -> DataFrame:
    """Salary averages that share one currency and pay period."""
    return salary_by_role(jobs.filter((F.col("salary_currency") == currency)
                                      & (F.col("salary_period") == period)))


def jobs_by_source(jobs: DataFrame) -> DataFrame:
    return (jobs.groupBy("source").agg(F.count("*").alias("job_count"))
            .orderBy(F.desc("job_count"), "source"))


def top_skills(skills: DataFrame, bridge: DataFrame, k: int = 10) -> DataFrame:
    counts = as_bridge(bridge).groupBy("skill_key").agg(F.count("*").alias("job_count"))
    return (counts.join(skills, "skill_key").select("skill_key", "skill_name", "job_count")
            .orderBy(F.desc("job_count"), "skill_name").limit(k))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return (df.groupBy(column).agg(F.count("*").alias("value_rows"))
            .orderBy(F.desc("value_rows"), column))
