"""Which skill next: profile coverage, what-if gain and the priority score.

`known` is the profile, a short list given by the caller. A posting's coverage
is the known share of its detected skills. Adding one missing skill can only
change postings that ask for it, so the gain of every skill is one sum over
the bridge and no posting is ever paired with a skill it does not mention.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.fixed import (COMPLEMENT_WEIGHT, COVERAGE_LEVEL, DEMAND_WEIGHT, HIGH_TIER,
                            MATCH_LEVEL, MEDIUM_TIER)
from postmill.functions.values import percent
from postmill.plans.views import KEY, job_baskets, skill_baskets, with_role


def _known(skill: Column, known: Sequence[str]) -> Column:
    return skill.isin(*known) if known else F.lit(False)


def _coverage(matched: Column, detected: Column) -> Column:
    return F.when(detected > 0, F.lit(100.0) * matched / detected)


def profiled_jobs(jobs: DataFrame, bridge: DataFrame, known: Sequence[str],
                  role: str | None = None) -> DataFrame:
    """Jobs of the role with detected and matched counts and the missing skills.

    Jobs without any skill stay, with zero counts.
    """
    baskets = bridge if {"role_family", "skills"} <= set(bridge.columns) else None
    if baskets is None:
        wanted = jobs if role is None else jobs.filter(F.col("role_family") == role)
        baskets = job_baskets(wanted, bridge)
    elif role is not None:
        baskets = baskets.filter(F.col("role_family") == role)
    return (baskets
            .select(KEY, "role_family", F.size("skills").alias("detected"),
                    F.filter("skills", lambda s: ~_known(s, known)).alias("missing"))
            .withColumn("matched", F.col("detected") - F.size("missing")))


def profile_coverage(jobs: DataFrame, bridge: DataFrame, known: Sequence[str],
                     role: str) -> DataFrame:
    """How well the profile covers the postings of a role (one row)."""
    share = _coverage(F.col("matched"), F.col("detected"))
    flags = {"jobs_with_1_plus_matches": F.col("matched") >= 1,
             "jobs_with_3_plus_matches": F.col("matched") >= MATCH_LEVEL,
             "jobs_at_50pct_plus_coverage": share >= COVERAGE_LEVEL}
    one = profiled_jobs(jobs, bridge, known, role).agg(
        F.count("*").alias("target_jobs"),
        F.count_if(F.col("detected") > 0).alias("jobs_with_detected_skills"),
        F.round(F.avg(share), 2).alias("avg_observed_skill_coverage_pct"),
        *[F.count_if(c).alias(n) for n, c in flags.items()])
    out = ["target_jobs", "jobs_with_detected_skills", "avg_observed_skill_coverage_pct"]
    for name in flags:
        out += [name, percent(F.col(name), F.col("target_jobs")).alias(f"{name}_pct")]
    return one.select(*out)


def marginal_gain(jobs: DataFrame, skills: DataFrame, bridge: DataFrame, known: Sequence[str],
                  role: str | None = None) -> DataFrame:
    """What learning each missing skill would add, for one role or every role.

    One aggregation answers everything: every job is dealt once under the null
    skill, which carries the totals of the role, and once under each of its
    missing skills. The totals then reach the skills by a window over that
    result, which is roles times dictionary in size.
    """
    d, m = F.col("detected"), F.col("matched")
    share, after = _coverage(m, d), _coverage(m + 1, d)
    dealt = (profiled_jobs(jobs, bridge, known, role)
             .select("role_family", "detected", "matched",
                     F.explode(F.concat(F.array(F.lit(None).cast("string")), F.col("missing")))
                     .alias("skill_key")))
    sums = dealt.groupBy("role_family", "skill_key").agg(
        F.count("*").alias("jobs"),
        F.count_if(d > 0).alias("analyzable"),
        F.sum(share).alias("share_sum"),
        F.sum(F.when(d > 0, F.lit(100.0) / d)).alias("added_sum"),
        F.count_if((share < COVERAGE_LEVEL) & (after >= COVERAGE_LEVEL)).alias("to_level"),
        F.count_if((m < MATCH_LEVEL) & (m + 1 >= MATCH_LEVEL)).alias("to_matches"))
    per_role = Window.partitionBy("role_family")

    def of_role(c: str) -> Column:
        return F.max(F.when(F.col("skill_key").isNull(), F.col(c))).over(per_role)

    placed = sums.withColumns({"role_jobs": of_role("jobs"), "n": of_role("analyzable"),
                               "base_sum": of_role("share_sum")})
    base = F.col("base_sum") / F.col("n")
    new = (F.col("base_sum") + F.col("added_sum")) / F.col("n")
    return (placed.filter("skill_key is not null")
            .join(skills, "skill_key")
            .select("role_family", "skill_key", "skill_name", "skill_category",
                    F.col("jobs").alias("skill_job_count"),
                    percent(F.col("jobs"), F.col("role_jobs")).alias("role_demand_pct"),
                    F.round(base, 2).alias("baseline_avg_coverage_pct"),
                    F.round(new, 2).alias("new_avg_coverage_pct"),
                    F.round(new - base, 2).alias("marginal_coverage_gain_pct_points"),
                    F.col("to_level").alias("jobs_newly_reaching_50pct"),
                    F.col("to_matches").alias("jobs_newly_reaching_3_matches")))


def next_skills(jobs: DataFrame, skills: DataFrame, bridge: DataFrame, known: Sequence[str],
                role: str) -> DataFrame:
    """marginal_gain of one role, best first."""
    return (marginal_gain(jobs, skills, bridge, known, role).drop("role_family")
            .orderBy(F.desc("marginal_coverage_gain_pct_points"), F.desc("role_demand_pct"),
                     "skill_key"))


def skill_priority(jobs: DataFrame, skills: DataFrame, bridge: DataFrame, known: Sequence[str],
                   role: str) -> DataFrame:
    """Weighted score of role demand and of how often a missing skill goes
    together with the known ones.

    Per job only (missing, known) combinations are formed; the null in each
    list stands for 'any', which makes the plain counts part of the same pass.
    Without known skills there is nothing to go together with, and no row.
    """
    target = jobs.filter(F.col("role_family") == role)
    nobody = F.array(F.lit(None).cast("string"))
    split = (with_role(skill_baskets(bridge), jobs, role)
             .select(F.filter("skills", lambda s: ~_known(s, known)).alias("missing"),
                     F.filter("skills", lambda s: _known(s, known)).alias("known")))
    counts = (split.select(F.explode(F.concat(nobody, "missing")).alias("skill_key"), "known")
              .select("skill_key", F.explode(F.concat(nobody, "known")).alias("known_key"))
              .groupBy("skill_key", "known_key").agg(F.count("*").alias("n")))
    role_jobs = target.agg(F.count("*").alias("n")).scalar()
    pct = percent(F.col("n"), F.col("known_jobs"))
    linked = F.col("known_key").isNotNull()
    known_jobs = F.max(F.when(F.col("skill_key").isNull(), F.col("n"))).over(
        Window.partitionBy("known_key"))
    per_skill = (counts.withColumn("known_jobs", known_jobs).filter("skill_key is not null")
                 .groupBy("skill_key")
                 .agg(F.max(F.when(~linked, F.col("n"))).alias("skill_job_count"),
                      F.sum(F.when(linked, pct).cast("decimal(9,2)")).alias("pct_sum"),
                      F.count_if(linked).alias("links"),
                      F.coalesce(F.sum(F.when(linked, F.col("n"))), F.lit(0)).alias("support")))
    share = percent(F.col("skill_job_count"), F.col("role_job_count"))
    # Decimal from here on: the inputs have two digits, so scores that fall on a
    # rounding or tier boundary are decided exactly.
    together = (F.coalesce("pct_sum", F.lit(0)).cast("decimal(16,2)")
                / F.lit(max(len(set(known)), 1)).cast("decimal(9,0)"))
    score = (F.lit(Decimal(str(DEMAND_WEIGHT))) * share.cast("decimal(9,2)")
             + F.lit(Decimal(str(COMPLEMENT_WEIGHT))) * together)
    return (per_skill.filter(F.lit(bool(known))).join(skills, "skill_key")
            .withColumn("role_job_count", role_jobs)
            .select("skill_key", "skill_name", "skill_category", "skill_job_count",
                    "role_job_count", share.alias("role_demand_pct"),
                    F.round(together, 2).cast("double").alias("avg_complementarity_pct"),
                    F.col("links").alias("known_skill_connections"),
                    F.col("support").alias("summed_pair_support"),
                    F.round(score, 2).cast("double").alias("priority_score"),
                    F.when(score >= HIGH_TIER, "High Priority")
                    .when(score >= MEDIUM_TIER, "Medium Priority")
                    .otherwise("Lower Priority").alias("priority_tier"))
            .orderBy(F.desc("priority_score"), "skill_key"))
