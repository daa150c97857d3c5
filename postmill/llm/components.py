"""Connected components by alternating star contractions, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from postmill.llm.common import written


def _noted(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """``edges``, written, and their number and a digest of them, taken on the way."""
    note = Observation()
    digest = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    edges = written(edges.observe(note, F.count(F.lit(1)).alias("n"), digest.alias("digest")), "edges")
    return edges, (note.get["n"], note.get["digest"])


def components(edges: DataFrame) -> DataFrame:
    """node, root: for each end of an edge (a, b), the smallest node that it reaches.

    Nodes without an edge to another are left out. Each round shuffles the edges a few
    times; a round's result is written, and rounds end when nothing changes. Minima are
    aggregated before the shuffle, and a node with many edges is only ever on the side of
    a join that adaptive execution may split.
    """
    edges, seen = _noted(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                         .distinct())
    while seen[0]:
        ways = [F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in ("ab", "ba")]
        both = edges.select(F.inline(F.array(*ways)))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Every larger neighbour of a node moves to the smallest node known there ...
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # ... and then every node and its smaller neighbours to the smallest of those.
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        edges, now = _noted(large.join(small, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                            .unionByName(small.select("a", F.col("m").alias("b"))).distinct())
        if now == seen:
            break
        seen = now
    return (edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
