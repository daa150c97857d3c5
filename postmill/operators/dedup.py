"""Deduplication with a stated order, repeat counts and duplicate groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.operators.skew import SLICES, join_group_facts


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """The first k rows of each group in the given order.

    Spark turns the rank filter into a group limit that also runs before the
    shuffle, so at most k rows of a group leave each input task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k).drop("_rank")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return top_rows(df, keys, [F.col(c).asc() for c in order])


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return top_rows(df, keys, [F.col(c).desc() for c in order])


def keep_first_collecting(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                          collect: str, out: str) -> DataFrame:
    """keep_first, plus the set of `collect` values seen anywhere in the group.

    One aggregation instead of a window, a dedup and a join: partial results
    are merged before the shuffle, so a hot key costs one row per input task.
    """
    keys, order = list(keys), list(order)
    first = F.min_by(F.struct("*"), F.struct(*order)).alias("_first")
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(first, F.collect_set(collect).alias(out))
            .select(*keys, *[F.col("_first")[c].alias(c) for c in rest], out))


def group_sizes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("group_rows"))


def duplicate_members(df: DataFrame, keys: Sequence[str], spread_by: Sequence[str],
                      slices: int = SLICES) -> DataFrame:
    """Every row whose key occurs more than once, with the size of its group.

    A group's rows are spread over `slices` parts at most, by `spread_by`."""
    repeated = group_sizes(df, keys).filter("group_rows > 1")
    return join_group_facts(df, repeated, keys, spread_by, slices)


def repeat_count(df: DataFrame, key: str, out: str = "repeated_rows") -> DataFrame:
    """Rows beyond the first of each key value; null counts as one value."""
    distinct = F.count_distinct(key) + F.when(F.count_if(F.col(key).isNull()) > 0, 1).otherwise(0)
    return df.agg((F.count("*") - distinct).alias(out))
