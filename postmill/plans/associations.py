"""Associations between skills that enough jobs share, for vocabularies of any size.

A pair that `min_support` jobs share has two skills with that many jobs each, and falls in
a hash bucket with that many pairs. So skills are counted first, then pairs of frequent
skills per bucket, and only pairs in frequent buckets are counted one by one: each pass
leaves out what cannot reach the support, and the last one is exact. What the passes know
is a bitmap each; a task sends at most as many counts as there are skills or buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.operators.buckets import BUCKETS, bitmap, bucket_of, in_bitmap
from postmill.plans.views import KEY, as_bridge, association_columns, skill_baskets

SKILL_BUCKETS = 1 << 16


def frequent_skills(bridge: DataFrame, min_support: int) -> DataFrame:
    """(skill_key, jobs) of the skills with enough jobs."""
    return (as_bridge(bridge).groupBy("skill_key").agg(F.count("*").alias("jobs"))
            .filter(F.col("jobs") >= min_support))


def _pairs(baskets: DataFrame) -> DataFrame:
    ordered = baskets.select(F.array_sort("skills").alias("s"))
    heads = ordered.select("s", F.posexplode("s").alias("at", "skill_1_key"))
    return heads.select("skill_1_key", F.explode(F.slice(
        "s", F.col("at") + 2, F.size("s"))).alias("skill_2_key"))


def frequent_pair_counts(bridge: DataFrame, min_support: int, buckets: int = BUCKETS,
                         skill_buckets: int = SKILL_BUCKETS) -> DataFrame:
    """As `views.pair_counts`, only pairs that at least `min_support` jobs share.

    `bridge` is unique on job and skill. More `buckets` leave fewer rare pairs to the last
    pass, more `skill_buckets` fewer rare skills; the result does not depend on either.
    """
    own = frequent_skills(bridge, min_support)
    in_skill = bucket_of(F.col("skill_key"), buckets=skill_buckets)
    known = bitmap(own.select(in_skill.alias("bucket")), "bucket", skill_buckets)
    kept = as_bridge(bridge).select(KEY, "skill_key").filter(in_bitmap(known, in_skill))
    pairs = _pairs(skill_baskets(kept))
    in_pair = bucket_of(F.col("skill_1_key"), F.col("skill_2_key"), buckets=buckets)
    full = (pairs.groupBy(in_pair.alias("bucket")).agg(F.count("*").alias("n"))
            .filter(F.col("n") >= min_support))
    counted = (pairs.filter(in_bitmap(bitmap(full, "bucket", buckets), in_pair))
               .groupBy("skill_1_key", "skill_2_key").agg(F.count("*").alias("cooccurrence_jobs"))
               .filter(F.col("cooccurrence_jobs") >= min_support))
    for side in ("skill_1", "skill_2"):
        counted = counted.join(own.select(F.col("skill_key").alias(f"{side}_key"),
                                          F.col("jobs").alias(f"{side}_jobs")), f"{side}_key")
    return counted


def associations(jobs: DataFrame, skills: DataFrame, bridge: DataFrame, min_support: int,
                 buckets: int = BUCKETS) -> DataFrame:
    """`views.skill_cooccurrence` of the pairs with enough jobs."""
    return association_columns(frequent_pair_counts(bridge, min_support, buckets), jobs, skills)
