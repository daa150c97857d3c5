from collections import defaultdict

import pytest

from postmill.llm import mixing
from llm_tables import docs_table, messy_rows


def water_fill(sizes, weights, cap=3):
    """Rounds: everyone gets a share by weight, what is above a cap is shared again."""
    target, open_ = {s: 0.0 for s in sizes}, {s for s in sizes if sizes[s] > 0}
    left = float(sum(sizes.values()))
    while left > 1e-9 and open_:
        total = sum(weights[s] for s in open_)
        over = {s for s in open_ if target[s] + left * weights[s] / total > cap * sizes[s]}
        if not over:
            for s in open_:
                target[s] += left * weights[s] / total
            break
        for s in over:
            left -= cap * sizes[s] - target[s]
            target[s] = float(cap * sizes[s])
        open_ -= over
    return target


def check(rows, got):
    sizes, count = defaultdict(int), lambda t: len((t or "").encode().split())
    for _, t, _, s in rows:
        sizes[s] += count(t)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, taken = water_fill(sizes, weights), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r.size
        assert (r.position is None) == (r.taken == 0) and (r.position is None or 0 <= r.position < 1)
        taken[r.source] += r.taken
    for s in sizes:
        assert taken[s] == round(target[s])
    assert sorted(str((r.doc_id, r.size)) for r in got) == sorted(str((i, count(t))) for i, t, *_ in rows)


@pytest.mark.parametrize("bucket_rows", [50_000, 3])
def test_targets_and_sums(messy, bucket_rows):
    frame = mixing.curriculum(messy, bucket_rows=bucket_rows)
    got = frame.collect()
    check(messy_rows(), got)
    places = [r.position for r in got if r.position is not None]
    assert places == sorted(places)
    assert all(r.position is None for r in got[len(places):])


def test_buckets_and_reruns_change_nothing(messy):
    plain = sorted(map(repr, mixing.curriculum(messy).collect()))
    assert plain == sorted(map(repr, mixing.curriculum(messy, bucket_rows=2).collect()))
    assert plain == sorted(map(repr, mixing.curriculum(messy.repartition(7)).collect()))


def test_many_sources_with_caps(spark):
    rows = [(i, "w " * n, "en", f"s{i % 11:02d}") for i, n in enumerate([5000, 3, 40, 1, 7, 900, 2, 2, 60, 0, 11] * 3)]
    check(rows, mixing.curriculum(docs_table(spark, rows)).collect())


def test_schedule_is_inverted(spark):
    knots = ((0.0, 1.0), (0.25, 3.0), (0.5, 0.0), (0.75, 0.0), (1.0, 2.0))
    shares = [i / 40 for i in range(40)]
    frame = spark.createDataFrame([(x,) for x in shares], "share double")
    times = [r[0] for r in frame.select(mixing.inverse_schedule(frame.share, knots)).collect()]

    def mass(t):
        total = 0.0
        for (a, u), (b, v) in zip(knots, knots[1:]):
            x = min(max(t - a, 0), b - a)
            total += u * x + (v - u) * x * x / (2 * (b - a))
        return total

    assert times == sorted(times)
    for share, t in zip(shares, times):
        assert mass(t) / mass(1.0) == pytest.approx(share, abs=1e-9)


def test_empty(empty):
    assert mixing.curriculum(empty).collect() == []
    assert mixing.curriculum(empty.filter("false")).columns[0] == "doc_id"
