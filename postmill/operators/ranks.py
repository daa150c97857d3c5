"""The place of every row in a total order, without sorting all rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.operators.shared import settled

# monotonically_increasing_id: the partition above, the row within it in these bits.
ROW_BITS = 33


def ranked(df: DataFrame, order: Sequence[Column], out: str = "row_rank") -> DataFrame:
    """`df` with the number of each row, from 1, in `order`.

    Rows are range-partitioned by the order and sorted within partitions, which is what a
    sorted file needs anyway, and written once with their place in their partition. The
    partitions are then counted, and each one's rows are moved up by the rows before it;
    the only window runs over one row per partition. The order must end in a unique key:
    then no set of equal rows is bound to one partition, and ranks are the same on every
    run. Partitions are as many as the session shuffles into.
    """
    placed = (df.repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumn("_place", F.monotonically_increasing_id()))
    rows = settled(placed, "ranked").withColumn("_part", F.shiftright("_place", ROW_BITS))
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1))
    offsets = (rows.groupBy("_part").agg(F.count("*").alias("_rows"))
               .select("_part", F.coalesce(before, F.lit(0)).alias("_before")))
    inside = F.col("_place").bitwiseAND((1 << ROW_BITS) - 1)
    return (rows.join(offsets, "_part").withColumn(out, F.col("_before") + inside + 1)
            .select(*df.columns, out))
