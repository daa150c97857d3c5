"""Bitmaps over hash buckets: a first pass that tells which rows a second one needs.

A row falls in a bucket by a hash of some columns. What is known of the buckets travels
as one bitmap of fixed size, a scalar of the plan, so the rows of all other buckets are
dropped where they are read and never shuffled. Buckets only ever keep too many rows;
the second pass is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of a bitmap unless stated otherwise: 128 KiB of bits.
BUCKETS = 1 << 20


def bucket_of(*columns: Column, buckets: int = BUCKETS, seed: int = 0) -> Column:
    """Null is a value like another; a seed gives an independent hash."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(buckets)).cast("int")


def bitmap(marked: DataFrame, bucket: str, buckets: int = BUCKETS) -> Column:
    """Scalar array<bigint> with the bits of all values of the column `bucket`.

    Words are or-ed within tasks first, so a task sends at most buckets / 64 rows, and the
    array has that length whatever there is to mark."""
    if buckets % 64:
        raise ValueError("buckets come in multiples of 64")
    words = marked.sparkSession.range(buckets // 64).select(
        F.col("id").cast("int").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    own = marked.select(F.shiftright(bucket, 6).alias("word"),
                        F.call_function("shiftleft", F.lit(1).cast("bigint"),
                                        F.col(bucket).bitwiseAND(63)).alias("bits"))
    merged = words.unionByName(own).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))),
                          lambda s: s["bits"])
    return merged.agg(ordered.alias("bitmap")).scalar()


def in_bitmap(bits: Column, bucket: Column) -> Column:
    return F.getbit(F.element_at(bits, F.shiftright(bucket, 6) + 1), bucket.bitwiseAND(63)) == 1
