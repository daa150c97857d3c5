"""Centroid clustering with the threshold algorithm.

Every round hands out, per dimension, the centroids sorted by their value there. A vector
walks each of these lists outward from its own value, always to the nearer side, and
computes the exact distance of every centroid it meets for the first time. What it has not
met lies beyond all frontiers, so the sum of the squared frontier distances bounds it from
below; the walk ends when this sum strictly exceeds the best exact distance. Ties are
thereby found, and go to the smaller number.

The vectors are read from a written table once a round. A task sends one row per cluster
and dimension, whatever the number of its vectors, and the driver sees centroids only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import written

CLUSTERS, ROUNDS, COMPONENTS, SCALE = 16, 3, 64, 64
#: Components stay below this, so that a sum of squares over up to 64 of them fits 64 bits.
REACH = 1 << 27
#: Vectors whose distances are held at once.
SLICE = 1_024


def whole_vectors(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id and floor(scale * x) of every component x, taken as a double.

    Vectors that are null, of another length, or with a null or non-finite component go.
    A component of ``REACH`` or more is an error, since distances would not fit."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    scaled = F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(float(scale))))
    fits = F.forall(x, lambda v: F.abs(v.cast("double") * F.lit(float(scale))) < float(REACH - 1))
    # Of a row that fails the first test the others are not looked at.
    kept = vectors.select("vec_id", "embedding").filter((F.size(x) == components) & finite)
    return kept.select("vec_id", F.when(fits, scaled).otherwise(
        F.raise_error(F.lit(f"components from {REACH} on are not supported")).cast("array<bigint>")).alias("vector"))


class SortedLists:
    """Centroids and, per dimension, their numbers in the order of their values there."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.numbers = np.argsort(centroids, axis=0, kind="stable")
        self.values = np.take_along_axis(centroids, self.numbers, axis=0)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid of each vector."""
        k, d = self.centroids.shape
        unmet = np.iinfo(np.int64).max
        distance = np.full((len(vectors), k), unmet, dtype=np.int64)
        right = np.empty((len(vectors), d), dtype=np.int64)
        for j in range(d):
            right[:, j] = np.searchsorted(self.values[:, j], vectors[:, j])
        left, live, dims = right - 1, np.arange(len(vectors)), np.arange(d)
        while len(live):
            v, lo, hi = vectors[live], left[live], right[live]
            below = np.where(lo >= 0, v - self.values[np.maximum(lo, 0), dims], 2 * REACH)
            above = np.where(hi < k, self.values[np.minimum(hi, k - 1), dims] - v, 2 * REACH)
            frontier = (np.minimum(below, above) ** 2).sum(axis=1)
            going = (frontier <= distance[live].min(axis=1)) & (distance[live] == unmet).any(axis=1)
            live, lo, hi, go_left = live[going], lo[going], hi[going], (below <= above)[going]
            at = np.where(go_left, lo, hi)
            met = np.zeros((len(live), k), dtype=bool)
            inside = (at >= 0) & (at < k)
            rows, columns = np.nonzero(inside)
            met[rows, self.numbers[at[rows, columns], columns]] = True
            rows, number = np.nonzero(met & (distance[live] == unmet))
            distance[live[rows], number] = ((vectors[live[rows]] - self.centroids[number]) ** 2).sum(axis=1)
            left[live] = lo - (go_left & inside)
            right[live] = hi + (~go_left & inside)
        number = distance.argmin(axis=1)
        return number, distance[np.arange(len(vectors)), number]


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every vector."""
    d = centroids.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = SortedLists(centroids)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                number, distance = lists.nearest(_matrix(part.column(1), d))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(number.astype(np.int32)), pa.array(distance)],
                                                 names=["vec_id", "cluster", "distance"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(assign, f"vec_id {kind}, cluster int, distance bigint")


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of the mean of each centroid's vectors; a centroid without any stays."""
    k, d = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, total = SortedLists(centroids), np.zeros((k, d + 1), dtype=np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                own = _matrix(batch.slice(start, SLICE).column(1), d)
                number, _ = lists.nearest(own)
                for c in np.unique(number):
                    total[c, :d] += own[number == c].sum(axis=0)
                    total[c, d] += int((number == c).sum())
        used = np.flatnonzero(total[:, d])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(used, d + 1).astype(np.int32)), pa.array(np.tile(np.arange(d + 1), len(used)).astype(np.int32)),
             pa.array(total[used].ravel())], names=["cluster", "dimension", "total"])

    sums = (vectors.mapInArrow(add, "cluster int, dimension int, total bigint").groupBy("cluster", "dimension")
            .agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect())  # clusters x dimensions
    found: dict[int, dict[int, int]] = {}
    for r in sums:
        found.setdefault(r.cluster, {})[r.dimension] = int(r.total)
    out = centroids.copy()
    for c, total in found.items():
        out[c] = [total[j] // total[d] for j in range(d)]
    return out


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS,
            scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid (array of bigint).

    One row per kept row of ``vectors`` (vec_id, embedding); see ``whole_vectors`` for what
    is kept. The first centroids are the vectors with the smallest SHA-256 of ``1:`` and
    the id, equal hashes by vector; with fewer vectors than clusters there are as many
    clusters as vectors. A null id counts as empty text. Repeated rows are vectors each;
    an empty table gives an empty result; other columns take no part.
    """
    own = written(whole_vectors(vectors, components, scale), "vectors")
    draw = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    start = own.orderBy(draw, "vector").select("vector").limit(clusters).collect()
    if not start:
        none = own.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"))
        return none.select("*", F.col("distance").alias("cluster_inertia"), F.col("distance").alias("inertia"),
                           F.array().cast("array<bigint>").alias("centroid"))
    centroids = np.array([r.vector for r in start], dtype=np.int64)
    for _ in range(rounds):
        centroids = moved(own, centroids)
    final = written(assigned(own, centroids), "assigned")
    sums = {r.cluster: int(r.n) for r in final.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()}  # one row per cluster
    facts = vectors.sparkSession.createDataFrame(
        [(c, n, sum(sums.values()), centroids[c].tolist()) for c, n in sums.items()],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    return final.join(F.broadcast(facts), "cluster").select(  # as many rows as clusters
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def _rounds_sql() -> str:
    """The rounds as plain SQL, every vector against every centroid."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, v, min(struct_pack(d := d, c := c)) AS best
  FROM (SELECT vec_id, v, c, list_sum(list_transform(list_zip(v, m), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d
        FROM own, c{r})
  GROUP BY vec_id, v)""")
        if r < ROUNDS:
            steps.append(f"""
s{r} AS MATERIALIZED (
  SELECT c, j, CAST((total - ((total % n) + n) % n) // n AS BIGINT) AS x
  FROM (SELECT best.c AS c, j, CAST(sum(v[j]) AS HUGEINT) AS total, CAST(count(*) AS HUGEINT) AS n
        FROM (SELECT best, v, unnest(range(1, {COMPONENTS + 1})) AS j FROM a{r}) GROUP BY 1, 2)),
c{r + 1} AS MATERIALIZED (
  SELECT c{r}.c, coalesce(n.m, c{r}.m) AS m FROM c{r} LEFT JOIN
    (SELECT c, list(x ORDER BY j) AS m FROM s{r} GROUP BY c) n ON n.c = c{r}.c)""")
    return ",".join(steps)


SQL = f"""
WITH own AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: isfinite(x))) = {COMPONENTS}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS m
  FROM (SELECT v, sha256('1:' || CAST(vec_id AS VARCHAR)) AS h FROM own ORDER BY h, v LIMIT {CLUSTERS})),
{_rounds_sql()}
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance,
       CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} ON c{ROUNDS}.c = best.c
"""
