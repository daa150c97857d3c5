import hashlib
import random

import numpy as np
import pytest

from postmill.llm import clustering

SCHEMA = "vec_id bigint, embedding array<float>, label int, cluster string, vector string, inertia string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 0, "x", "x", "x") for r in rows], SCHEMA)


def brute(rows, k, rounds, d):
    own = []
    for i, v in rows:
        if v is not None and len(v) == d and all(x is not None and np.isfinite(x) for x in v):
            own.append((i, tuple(int(np.floor(64 * float(np.float32(x)))) for x in v)))
    start = sorted(own, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in start[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        got = [(nearest(v)[1], v) for _, v in own]
        for n in range(len(centroids)):
            mine = [v for c, v in got if c == n]
            if mine:
                centroids[n] = [sum(col) // len(mine) for col in zip(*mine)]
    out = [(i, *reversed(nearest(v))) for i, v in own]
    total = {n: sum(d for _, c, d in out if c == n) for n in range(len(centroids))}
    return sorted(((i, c, d, total[c], sum(total.values()), centroids[c]) for i, c, d in out), key=repr)


def vectors(draw, n, d, spread=1.0):
    """Some vectors in a few clumps, on a coarse grid so that distances tie."""
    middles = [[draw.uniform(-spread, spread) for _ in range(d)] for _ in range(5)]
    return [(i, [round(m + draw.uniform(-0.2, 0.2), 1) for m in draw.choice(middles)]) for i in range(n)]


@pytest.mark.parametrize("seed, k, d", [(1, 4, 3), (2, 7, 8), (3, 16, 64), (4, 3, 1)])
def test_against_brute_force(spark, seed, k, d):
    rows = vectors(random.Random(seed), 120, d)
    got = clustering.cluster(table(spark, rows).repartition(5), clusters=k, components=d)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, k, 3, d)


def test_bad_rows_go_and_ties_repeats_and_null_ids_stay(spark):
    draw = random.Random(9)
    rows = vectors(draw, 40, 4)
    rows += [(None, [0.0, 0.1, 0.2, 0.3]), (None, [0.5, 0.1, 0.2, 0.3]), rows[0], rows[0], (7, [0.0] * 4)]
    rows += [(100 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(30)]
    bad = [(200, None), (201, []), (202, [1.0] * 3), (203, [1.0] * 5), (204, [1.0, None, 1.0, 1.0]),
           (205, [1.0, float("nan"), 1.0, 1.0]), (206, [float("inf"), 1.0, 1.0, 1.0])]
    got = clustering.cluster(table(spark, rows + bad), clusters=6, components=4)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 6, 3, 4)


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = vectors(random.Random(4), 3, 4)
    got = clustering.cluster(table(spark, rows), clusters=16, components=4)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 16, 3, 4)
    none = clustering.cluster(table(spark, []), components=4)
    assert none.collect() == [] and none.dtypes == got.dtypes


def test_too_large_is_an_error(spark):
    with pytest.raises(Exception, match="not supported"):
        clustering.cluster(table(spark, [(1, [1e30, 0.0])]), components=2)


def test_walk_stops_early_and_finds_ties():
    lists = clustering.SortedLists(np.array([[0, 0], [10, 0], [0, 10], [10, 10], [0, 0]]))
    number, distance = lists.nearest(np.array([[5, 5], [0, 0], [10, 5], [6, 0], [-3, 99]]))
    assert number.tolist() == [0, 0, 1, 1, 2] and distance.tolist() == [50, 0, 25, 16, 9 + 89 ** 2]
