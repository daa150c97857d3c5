"""Joining rows to facts about their group when one group may be huge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Slices that the rows of every group, small or large, are dealt over unless the caller
# states more. A group of a third of all rows needs about as many as the cluster has cores.
SLICES = 64


def join_group_facts(rows: DataFrame, facts: DataFrame, keys: Sequence[str],
                     spread_by: Sequence[str], slices: int = SLICES) -> DataFrame:
    """Inner join of `rows` with `facts`, which has one row per key, or a few.

    Every row gets a slice by a hash of `spread_by`. The facts first meet the
    (key, slice) pairs that occur, at most `slices` per key and counted before
    the shuffle, and then the rows by key and slice. So every group is spread,
    whatever its size, with no list of large groups and nothing broadcast, and
    the result is the same for any number of slices. Null keys match each
    other, as they do when the facts are grouped.
    """
    names = {k: f"_key_{i}" for i, k in enumerate(keys)}
    dealt = rows.withColumn("_slice", F.pmod(F.xxhash64(*spread_by), F.lit(slices)).cast("int"))
    pairs = dealt.groupBy(*keys, "_slice").agg(F.count("*").alias("_rows")).select(
        *[F.col(k).alias(n) for k, n in names.items()], F.col("_slice").alias("_part"))
    met = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    spread = facts.join(pairs, met, "inner").drop(*keys)
    return (dealt.join(spread, [*met, F.col("_slice") == F.col("_part")], "inner")
            .drop("_slice", "_part", *names.values()))
