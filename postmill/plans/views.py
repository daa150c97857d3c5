"""Demand, co-occurrence and salary views.

Inputs: `jobs` (one row per source_record_key), `skills` (one row per
skill_key) and `bridge` (unique on source_record_key, skill_key; see
`checks.duplicate_keys`), or the same as baskets: one row per job with the
array `skills`, with or without its role (`job_baskets`). Uniqueness is why plain counts stand in for distinct
counts, which would shuffle the whole bridge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmill.fixed import VIEW_NAMES
from postmill.functions.values import exact_mean, percent, ratio

KEY = "source_record_key"


def row_total(df: DataFrame) -> Column:
    return df.agg(F.count("*").alias("n")).scalar()


def skill_baskets(bridge: DataFrame) -> DataFrame:
    """One row per job with its set of skills, at most one dictionary long.

    This is the only shuffle of the bridge: sets are merged before it, and all
    that follows works inside the row or on dictionary-sized results. A table
    that already holds baskets passes through.
    """
    if "skills" in bridge.columns:
        return bridge
    return bridge.groupBy(KEY).agg(F.collect_set("skill_key").alias("skills"))


def as_bridge(baskets: DataFrame) -> DataFrame:
    """One row per job and skill; a table that already is a bridge passes through."""
    if "skill_key" in baskets.columns:
        return baskets
    kept = [c for c in baskets.columns if c != "skills"]
    return baskets.select(*kept, F.explode("skills").alias("skill_key"))


def with_role(skilled: DataFrame, jobs: DataFrame, role: str | None = None) -> DataFrame:
    """Baskets or bridge with the role of each job; nothing to join if it is there already."""
    if "role_family" not in skilled.columns:
        skilled = skilled.join(jobs.select(KEY, "role_family"), KEY)
    return skilled if role is None else skilled.filter(F.col("role_family") == role)


def job_baskets(jobs: DataFrame, bridge: DataFrame) -> DataFrame:
    """Every job with its role and its skills, an empty array where it has none.

    The one join of jobs and bridge that all views and gap queries share. Kept
    as a table it can be passed wherever a bridge is expected, and what follows
    shuffles only dictionary-sized results.
    """
    skills = F.coalesce("skills", F.array().cast("array<string>")).alias("skills")
    return (jobs.select(KEY, "role_family").join(skill_baskets(bridge), KEY, "left")
            .select(KEY, "role_family", skills))


def skill_demand(jobs: DataFrame, skills: DataFrame, bridge: DataFrame) -> DataFrame:
    """Jobs that ask for each skill and their share of all jobs."""
    counts = as_bridge(bridge).groupBy("skill_key").agg(F.count("*").alias("job_count"))
    return counts.join(skills, "skill_key").select(
        "skill_key", "skill_name", "skill_category", "job_count",
        percent(F.col("job_count"), row_total(jobs)).alias("job_share_pct"))


def role_summary(jobs: DataFrame) -> DataFrame:
    """Jobs, share of all jobs and distinct companies per role."""
    return (jobs.groupBy("role_family")
            .agg(F.count("*").alias("job_count"),
                 F.count_distinct("company_name").alias("company_count"))
            .select("role_family", "job_count",
                    percent(F.col("job_count"), row_total(jobs)).alias("job_share_pct"),
                    "company_count"))


def role_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("role_family").agg(F.count("*").alias("role_job_count"))


def role_skill_demand(jobs: DataFrame, skills: DataFrame, bridge: DataFrame) -> DataFrame:
    """Jobs per role and skill and their share of the jobs of the role."""
    counts = (with_role(as_bridge(bridge), jobs)
              .groupBy("role_family", "skill_key").agg(F.count("*").alias("skill_job_count")))
    return (counts.join(role_counts(jobs), "role_family").join(skills, "skill_key")
            .select("role_family", "skill_key", "skill_name", "skill_category",
                    "skill_job_count", "role_job_count",
                    percent(F.col("skill_job_count"), F.col("role_job_count"))
                    .alias("role_skill_share_pct")))


def skill_matrix(baskets: DataFrame, *by: str) -> DataFrame:
    """Jobs per unordered skill pair, each skill also paired with itself.

    The pairs of a job exist only while its row streams through; they are
    summed per task, so the shuffle carries one row per pair and task.
    """
    ordered = baskets.select(*by, F.array_sort("skills").alias("s"))
    heads = ordered.select(*by, "s", F.posexplode("s").alias("at", "skill_1_key"))
    pairs = heads.select(*by, "skill_1_key",
                         F.explode(F.slice("s", F.col("at") + 1, F.size("s") - F.col("at")))
                         .alias("skill_2_key"))
    return (pairs.groupBy(*by, "skill_1_key", "skill_2_key")
            .agg(F.count("*").alias("cooccurrence_jobs")))


def pair_counts(baskets: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pairs with the job counts of both members.

    The counts sit on the diagonal of the matrix, so two windows over the
    dictionary-sized matrix pick them up without reading the data again.
    """
    own = F.when(F.col("skill_1_key") == F.col("skill_2_key"), F.col("cooccurrence_jobs"))
    return (skill_matrix(baskets, *by)
            .withColumn("skill_1_jobs", F.max(own).over(Window.partitionBy(*by, "skill_1_key")))
            .withColumn("skill_2_jobs", F.max(own).over(Window.partitionBy(*by, "skill_2_key")))
            .filter("skill_1_key <> skill_2_key"))


def _pair_names(pairs: DataFrame, skills: DataFrame) -> DataFrame:
    for side in ("skill_1", "skill_2"):
        names = skills.select(F.col("skill_key").alias(f"{side}_key"),
                              F.col("skill_name").alias(f"{side}_name"))
        pairs = pairs.join(names, f"{side}_key")
    return pairs


def _association(total: Column) -> dict[str, Column]:
    both = F.col("cooccurrence_jobs").cast("double")
    one, two = F.col("skill_1_jobs").cast("double"), F.col("skill_2_jobs").cast("double")
    return {
        "pct_skill_1_with_skill_2": percent(both, one),
        "pct_skill_2_with_skill_1": percent(both, two),
        "jaccard_similarity": F.round(ratio(both, one + two - both), 4),
        "lift": F.round(ratio(both * total, one * two), 4),
    }


def skill_cooccurrence(jobs: DataFrame, skills: DataFrame, bridge: DataFrame) -> DataFrame:
    """Support, conditional shares, Jaccard similarity and lift of skill pairs."""
    return association_columns(pair_counts(skill_baskets(bridge)), jobs, skills)


def association_columns(pairs: DataFrame, jobs: DataFrame, skills: DataFrame) -> DataFrame:
    """Names and measures of counted pairs."""
    total = row_total(jobs)
    return _pair_names(pairs, skills).select(
        "skill_1_key", "skill_1_name", "skill_2_key", "skill_2_name",
        "skill_1_jobs", "skill_2_jobs", "cooccurrence_jobs",
        percent(F.col("cooccurrence_jobs"), total).alias("pair_job_share_pct"),
        *[c.alias(n) for n, c in _association(total).items()])


def role_skill_cooccurrence(jobs: DataFrame, skills: DataFrame, bridge: DataFrame,
                            role: str | None = None) -> DataFrame:
    """As skill_cooccurrence within each role."""
    pairs = pair_counts(with_role(skill_baskets(bridge), jobs, role), ["role_family"])
    named = _pair_names(pairs.join(role_counts(jobs), "role_family"), skills)
    total = F.col("role_job_count")
    return named.select(
        "role_family", "skill_1_key", "skill_1_name", "skill_2_key", "skill_2_name",
        "skill_1_jobs", "skill_2_jobs", "cooccurrence_jobs", "role_job_count",
        percent(F.col("cooccurrence_jobs"), total).alias("pair_role_share_pct"),
        *[c.alias(n) for n, c in _association(total).items()])


def salary_by_role(jobs: DataFrame) -> DataFrame:
    """Average low, high and middle salary per role, currency and period."""
    low, high = F.col("salary_min"), F.col("salary_max")
    middle = F.coalesce((low + high) / F.lit(2.0), low, high)
    return (jobs.filter((low.isNotNull() | high.isNotNull())
                        & F.col("salary_currency").isNotNull()
                        & F.col("salary_period").isNotNull())
            .groupBy("role_family", "salary_currency", "salary_period")
            .agg(F.count("*").alias("salary_job_count"),
                 exact_mean(low).alias("avg_salary_min"),
                 exact_mean(high).alias("avg_salary_max"),
                 exact_mean(middle).alias("avg_salary_midpoint")))


def view_frames(jobs: DataFrame, skills: DataFrame, bridge: DataFrame) -> dict[str, DataFrame]:
    """The six views by name."""
    frames = (skill_demand(jobs, skills, bridge), role_summary(jobs),
              role_skill_demand(jobs, skills, bridge), skill_cooccurrence(jobs, skills, bridge),
              role_skill_cooccurrence(jobs, skills, bridge), salary_by_role(jobs))
    return dict(zip(VIEW_NAMES, frames))


def register_views(spark: SparkSession, jobs: DataFrame, skills: DataFrame,
                   bridge: DataFrame) -> list[str]:
    """The six views under their names for SQL of this session; `versions.create_views`
    makes views that outlive it."""
    frames = view_frames(jobs, skills, bridge)
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)
    return list(frames)
