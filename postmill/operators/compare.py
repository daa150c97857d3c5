"""Comparing tables and finding repeated keys by digests of hash buckets.

Each check reads its tables twice. The first pass makes a small digest per bucket, merged
within tasks before it is shuffled; the second one shuffles only rows of buckets whose
digests leave a doubt, and is exact. Rows count as equal where they group together: nulls
equal each other, and so do -0.0 and 0.0. Hand over tables, not plans that cost much to
compute twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.operators.buckets import BUCKETS, bitmap, bucket_of, in_bitmap

# Buckets of a set comparison with up to this many values of the dimension are decided by
# their digests; fuller ones are always compared value by value.
SURE_VALUES = 2


def _hash(seed: int, columns: Sequence[str]) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in columns])


def _both(left: DataFrame, right: DataFrame) -> DataFrame:
    return (left.withColumn("_count", F.lit(1))
            .unionByName(right.select(*left.columns).withColumn("_count", F.lit(-1))))


def set_difference(left: DataFrame, right: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows on one side only, as bags, with the side they are on.

    A bucket's digest is its number of rows and the sums of two independent 64-bit hashes,
    left minus right. It is zero where both sides hold the same rows equally often; where
    they do not it is zero with a chance of 2^-128, and only then would a difference go
    unseen. So equality is certain up to that chance, and a reported row is certain. What
    does not cancel out is repeated as often as it is left over.
    """
    columns = left.columns
    both = _both(left, right)
    bucket = bucket_of(*[F.col(c) for c in columns], buckets=buckets)
    sign = F.col("_count").cast("decimal(38,0)")
    sums = [F.sum(sign * _hash(s, columns).cast("decimal(20,0)")).alias(f"h{s}") for s in (1, 2)]
    apart = (both.groupBy(bucket.alias("bucket")).agg(F.sum("_count").alias("n"), *sums)
             .filter("n <> 0 or h1 <> 0 or h2 <> 0"))
    asked = both.filter(in_bitmap(bitmap(apart, "bucket", buckets), bucket))
    return (asked.groupBy(*columns).agg(F.sum("_count").alias("_left"))
            .filter("_left <> 0")
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.abs("_left"))))
            .withColumn("side", F.when(F.col("_left") > 0, "left").otherwise("right"))
            .select(*columns, "side"))


def dimension_mismatch(dimension: DataFrame, dimension_key: str, fact: DataFrame,
                       fact_key: str, buckets: int = BUCKETS) -> DataFrame:
    """Values found in only one of a dimension and the values of a fact, with their side.

    A value may occur any number of times, so the digest is made of functions that repeats
    do not change: least and greatest of one hash, all bits set and all bits shared of two
    more, by side. With at most two values in the dimension, least and greatest name both;
    a third one in the fact would have to lie between them and add no bit to either
    hash, nor clear one: a chance below 10^-15. Fuller buckets are compared always, so let
    `buckets` be a few times the number of values.
    """
    both = _both(dimension.select(F.col(dimension_key).alias("value")),
                 fact.select(F.col(fact_key).alias("value")))
    bucket = bucket_of(F.col("value"), buckets=buckets)
    digests = []
    for side in (1, -1):
        mine = F.col("_count") == side
        one, two, three = (F.when(mine, _hash(s, ["value"])) for s in (1, 2, 3))
        digests.append(F.struct(F.min(one), F.max(one), F.bit_or(two), F.bit_and(two),
                                F.bit_or(three), F.bit_and(three)))
    doubt = (both.groupBy(bucket.alias("bucket"))
             .agg(F.count_if(F.col("_count") == 1).alias("n"), digests[0].alias("left"),
                  digests[1].alias("right"))
             .filter((F.col("n") > SURE_VALUES) | ~F.col("left").eqNullSafe(F.col("right"))))
    asked = both.filter(in_bitmap(bitmap(doubt, "bucket", buckets), bucket))
    # A set, so one row per value and side, put together within tasks first.
    left, right = F.max(F.col("_count") == 1), F.max(F.col("_count") == -1)
    return (asked.groupBy("value").agg(left.alias("_in_left"), right.alias("_in_right"))
            .filter("_in_left <> _in_right")
            .select("value", F.when(F.col("_in_left"), "left").otherwise("right").alias("side")))


def duplicate_keys(df: DataFrame, keys: Sequence[str], ignore_case: bool = False,
                   buckets: int = BUCKETS) -> DataFrame:
    """Keys that occur more than once, with their number of rows.

    The first pass counts rows per bucket of the key's hash, within tasks first, and sends
    a bucket's number and count, never a key; keys alone in their bucket are unique and go
    no further. That is nearly all of them while `buckets` is a few times the number of
    keys; with fewer buckets the second pass shuffles more keys, and is exact all the same.
    """
    columns = [(F.lower(c) if ignore_case else F.col(c)).alias(c) for c in keys]
    keyed = df.select(*columns)
    bucket = bucket_of(*[F.col(c) for c in keys], buckets=buckets)
    again = keyed.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).filter("n > 1")
    return (keyed.filter(in_bitmap(bitmap(again, "bucket", buckets), bucket))
            .groupBy(*keys).agg(F.count("*").alias("key_rows")).filter("key_rows > 1"))
