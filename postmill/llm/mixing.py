"""Mixing sources to target weights by a time-varying curriculum.

Every source has a target (its weight's share of all words, at most a multiple of its
size) and a schedule that spreads that target over the run. A source's documents stand
in one random but repeatable order and are taken round after round until the target is
met. The words taken before a document, as a share of the target, are inverted through
the integral of the schedule; that is its training position in [0, 1).

Running totals come in two levels, so no source, however large, is summed by one task:
documents are dealt into random buckets of bounded size, buckets are summed, and the
sums before each bucket are added to those within it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.common import WORD, written

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
#: Per weight, knots (time, relative weight) of its schedule, joined by straight lines:
#: heavy sources come early, light ones late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
#: Documents in a bucket, about.
BUCKET_ROWS = 5_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS,
                   max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, turn (0 for the first weight), source_size, target: one row per source.

    Targets rise together with one level, ``level * weight``, and stop at the cap. In the
    order of cap / weight the sources that stop come first; one pass of running sums
    finds them, with what is left divided by weight among the rest."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    cap = F.lit(max_repeats) * F.col("source_size")
    everything = Window.partitionBy()
    before = (Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
              .rowsBetween(Window.unboundedPreceding, -1))
    level = ((F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
             / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    left = ((F.col("all") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything))
            / (F.col("weights") - F.sum(F.when(F.col("capped"), F.col("weight")).otherwise(0.0)).over(everything)))
    return (sources.withColumn("turn", turn)
            .withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), F.col("turn") + 1))
            .withColumn("cap", cap)
            .withColumns({"all": F.sum("source_size").over(everything), "weights": F.sum("weight").over(everything)})
            .withColumn("capped", (F.col("source_size") == 0) | (level * F.col("weight") > F.col("cap")))
            .withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double"))
                        .otherwise(left * F.col("weight")))
            .select("source", "turn", "source_size", "target"))


def inverse_schedule(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which ``share`` (0 to 1) of a schedule's integral has passed."""
    pieces, total = [], 0.0
    for (t0, a), (t1, b) in zip(knots, knots[1:], strict=False):
        pieces.append((t0, t1, a, b, total))
        total += (t1 - t0) * (a + b) / 2
    if total <= 0:
        raise ValueError("a schedule needs weight above zero")
    mass, time = share * total, F.lit(float(knots[-1][0]))
    for t0, t1, a, b, before in reversed(pieces):
        slope, rest = (b - a) / (t1 - t0), F.greatest(mass - before, F.lit(0.0))
        if math.isclose(slope, 0.0, abs_tol=1e-12):
            inside = rest / a if a else F.lit(0.0)
        else:
            inside = (F.sqrt(F.greatest(a * a + 2 * slope * rest, F.lit(0.0))) - a) / slope
        end = before + (t1 - t0) * (a + b) / 2
        time = F.when(mass < end, F.lit(t0) + inside).otherwise(time)
    return time


def curriculum(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS,
               schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
               bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, position, in training order.

    ``taken`` counts repeats and is at most ``max_repeats`` times ``size``; the sum over a
    source is its target, rounded. ``position`` is null for documents of which nothing is
    taken; those come last. Null texts have no words; null sources are one source, the
    last; a null id is an id like another. Rows with equal id are separate documents.
    Ties in position go by id. An empty table gives an empty result.
    """
    draw = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    sized = written(docs.select("doc_id", F.col("source").cast("string").alias("source"),
                                word_count(F.col("text")).alias("size"), draw.alias("draw")), "sized")
    buckets = max(1, math.ceil(sized.count() / bucket_rows))
    bucket = F.floor(F.conv(F.substring("draw", 1, 8), 16, 10).cast("double") / 2.0 ** 32 * buckets)
    rows = sized.withColumn("bucket", bucket)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = (rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
            .withColumn("offset", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
            .drop("bucket_size"))
    targets = source_targets(sized, weights, max_repeats)
    at = (sums.alias("a").join(targets.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
          .select("a.source", "bucket", "offset", "turn", "source_size", "target"))
    within = (Window.partitionBy("source", "bucket").orderBy("draw", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = (rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).alias("r")
              .join(at.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))
                    & (F.col("r.bucket") == F.col("t.bucket")))
              .select("r.doc_id", "r.source", "r.size", "source_size", "target", "turn",
                      (F.col("offset") + F.col("inside")).alias("before")))
    words = F.round("target").cast("long")
    rounds = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("words") - F.col("rounds") * F.col("source_size")
    taken = (F.col("rounds") * F.col("size")
             + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))).cast("long")
    share = F.col("before") / F.col("words")
    time = F.lit(None).cast("double")
    for turn in range(len(weights)):
        time = F.when(F.col("turn") == turn, inverse_schedule(share, schedules[turn % len(schedules)])).otherwise(time)
    return (placed.withColumn("words", words).withColumn("rounds", rounds).withColumn("taken", taken)
            .withColumn("position", F.when((F.col("taken") > 0) & (F.col("words") > 0), time))
            .select("doc_id", "source", "size", "source_size", "target", "taken", "position")
            .orderBy(F.col("position").asc_nulls_last(), "doc_id"))


#: target, by rounds in which what stands above its cap is reshared, is built here from the
#: level at which caps and shares use up all words: the largest level that does not exceed them.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS draw,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn,
         [5.0, 2.0, 1.0][1 + turn]::DOUBLE AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT a.source, (SELECT sum(source_size) FROM sources) AS everything,
         3 * a.source_size / a.weight AS level,
         (SELECT sum(least(3 * b.source_size, 3 * a.source_size / a.weight * b.weight)) FROM sources b) AS used
  FROM sources a),
stopped AS (SELECT source FROM levels WHERE used < everything),
rest AS (
  SELECT (SELECT sum(source_size) FROM sources)
         - coalesce(sum(3 * source_size) FILTER (WHERE halted), 0) AS words,
         sum(weight) FILTER (WHERE NOT halted) AS weight
  FROM (SELECT *, EXISTS (SELECT 1 FROM stopped x WHERE x.source IS NOT DISTINCT FROM s.source) AS halted
        FROM sources s)),
targets AS (
  SELECT source, source_size, turn,
         CASE WHEN EXISTS (SELECT 1 FROM stopped x WHERE x.source IS NOT DISTINCT FROM s.source)
              THEN CAST(3 * source_size AS DOUBLE) ELSE rest.words / rest.weight * s.weight END AS target
  FROM sources s, rest),
placed AS (
  SELECT doc_id, z.source, size, source_size, target, turn, CAST(round(target) AS BIGINT) AS words,
         coalesce(sum(size) OVER (PARTITION BY z.source ORDER BY draw, doc_id, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized z JOIN targets t ON z.source IS NOT DISTINCT FROM t.source),
mixed AS (
  SELECT *, CAST(CASE WHEN source_size = 0 THEN 0 ELSE words // source_size * size
                      + greatest(0, least(size, words % source_size - before)) END AS BIGINT) AS taken
  FROM placed)
SELECT doc_id, size, source_size, round(target, 6) AS target, taken,
       round(CASE WHEN taken = 0 THEN NULL
                  WHEN turn = 0 THEN 1.5 - sqrt(2.25 - 2.0 * before / words)
                  WHEN turn = 1 THEN before / words
                  ELSE sqrt(0.25 + 2.0 * before / words) - 0.5 END, 9) AS position
FROM mixed
"""
