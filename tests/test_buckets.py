"""Bitmaps of buckets and what is built on them: comparisons, unique keys, ranks, pairs."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postmill.operators import checks
from postmill.operators.buckets import bitmap, bucket_of, in_bitmap
from postmill.operators.ranks import ranked
from postmill.plans.associations import frequent_pair_counts
from postmill.plans.rule_table import classify_by_table, rule_problems
from postmill.plans.views import KEY, pair_counts, skill_baskets

BAG = "a int, b string, c double"


def bag(draw, n):
    return [(draw.choice([None, *range(40)]), draw.choice([None, "", "x", "y"]), draw.choice([0.0, -0.0, 1.5, None]))
            for _ in range(n)]


def plain(row):
    return tuple(0.0 if x == 0.0 and isinstance(x, float) else x for x in row)


def test_bitmap_tells_marked_buckets(spark):
    rows = spark.range(5_000).withColumn("bucket", bucket_of(F.col("id"), buckets=1 << 16))
    marked = rows.filter("id % 7 = 0")
    hit = in_bitmap(bitmap(marked, "bucket", 1 << 16), F.col("bucket"))
    own = {r.bucket for r in marked.collect()}
    assert {r.id for r in rows.filter(hit).collect()} == {r.id for r in rows.collect() if r.bucket in own}
    assert rows.filter(in_bitmap(bitmap(marked.limit(0), "bucket", 64), F.lit(3))).count() == 0
    with pytest.raises(ValueError):
        bitmap(marked, "bucket", 100)


# One of 64 buckets makes all rows meet, many leave each alone.
@pytest.mark.parametrize("buckets", [64, 1 << 20])
@pytest.mark.parametrize("seed", [1, 2])
def test_set_difference_of_bags(spark, buckets, seed):
    draw = random.Random(seed)
    left = bag(draw, 400)
    right = left[:] if seed == 1 else draw.sample(left, 350) + bag(draw, 60)
    draw.shuffle(right)
    one, two = (Counter(map(plain, rows)) for rows in (left, right))
    want = sorted([(*r, "left") for r in (one - two).elements()] + [(*r, "right") for r in (two - one).elements()], key=repr)
    got = checks.set_difference(spark.createDataFrame(left, BAG), spark.createDataFrame(right, BAG).select("c", "a", "b"), buckets)
    assert got.columns == ["a", "b", "c", "side"]
    assert sorted(((*plain(r[:3]), r[3]) for r in map(tuple, got.collect())), key=repr) == want


@pytest.mark.parametrize("buckets", [64, 1 << 20])
def test_dimension_mismatch(spark, buckets):
    draw = random.Random(5)
    dimension = [(i,) for i in range(3_000)] + [(None,)]
    fact = [(draw.choice([None, *range(20, 3_050)]),) for _ in range(30_000)]
    have, used = set(dimension), set(fact)
    want = sorted([(v[0], "left") for v in have - used] + [(v[0], "right") for v in used - have], key=repr)
    got = checks.dimension_mismatch(spark.createDataFrame(dimension, "k int"), "k",
                                    spark.createDataFrame(fact, "f int"), "f", buckets)
    assert sorted(map(tuple, got.collect()), key=repr) == want and len(want) > 20


def test_only_rows_of_doubtful_buckets_are_shuffled(spark, tmp_path):
    rows = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"))
    rows.write.parquet(str(tmp_path / "left"))
    rows.filter("k <> 777").write.parquet(str(tmp_path / "right"))
    left, right = (spark.read.parquet(str(tmp_path / x)) for x in ("left", "right"))
    got = checks.set_difference(left, right)
    assert [tuple(r) for r in got.collect()] == [(777, 2331, "left")]
    # The bitmap is a filter below the exchange: what passes it is all that is shuffled.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    main = plan[:plan.index("Subquery")] if "Subquery" in plan else plan
    assert main.count("getbit") + main.count("scalar-subquery") >= 1
    asked = bucket_of(F.col("k"), F.col("v"))
    only = right.withColumn("bucket", asked).join(left.filter("k = 777").select(asked.alias("bucket")), "bucket")
    assert only.count() < 5


@pytest.mark.parametrize("buckets", [64, 1 << 20])
def test_duplicate_keys_in_two_passes(spark, buckets):
    draw = random.Random(3)
    rows = [(f"K{draw.randrange(3_000)}", draw.choice([None, "s", "t"])) for _ in range(3_000)] + [(None, None)] * 2
    df = spark.createDataFrame(rows, "k string, s string")
    want = sorted(((*k, n) for k, n in Counter(rows).items() if n > 1), key=repr)
    assert sorted(map(tuple, checks.duplicate_keys(df, ["k", "s"], buckets=buckets).collect()), key=repr) == want
    low = spark.createDataFrame([("Ab",), ("aB",), ("c",)], "k string")
    assert [tuple(r) for r in checks.duplicate_keys(low, ["k"], ignore_case=True, buckets=buckets).collect()] == [("ab", 2)]


def test_ranks_are_those_of_a_full_sort(spark):
    draw = random.Random(4)
    rows = [(i, draw.choice([None, 1, 2, 3]), draw.choice("abc")) for i in range(2_000)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "id int, x int, y string")
    order = [F.col("x").desc_nulls_last(), F.col("y"), F.col("id")]
    got = ranked(df.repartition(7), order)
    assert got.columns == ["id", "x", "y", "row_rank"]
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2], r[0]))
    assert [r.id for r in sorted(got.collect(), key=lambda r: r.row_rank)] == [r[0] for r in want]
    assert sorted(r.row_rank for r in got.collect()) == list(range(1, 2_001))
    assert ranked(df.limit(0), order).count() == 0


def test_rank_windows_run_over_partitions_only(spark):
    plan = ranked(spark.range(1_000).repartition(5), [F.col("id")])._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window"):]
    assert "Aggregate" in window  # one row per partition comes into it


@pytest.mark.parametrize("buckets, skill_buckets", [(64, 64), (1 << 20, 1 << 16)])
def test_frequent_pairs_are_all_pairs_with_support(spark, buckets, skill_buckets):
    draw = random.Random(9)
    rows = [(i, f"s{s}") for i in range(300) for s in {int(draw.paretovariate(0.8)) % 60 for _ in range(12)}]
    bridge = spark.createDataFrame(rows, f"{KEY} int, skill_key string")
    want = sorted((r.skill_1_key, r.skill_2_key, r.cooccurrence_jobs, r.skill_1_jobs, r.skill_2_jobs)
                  for r in pair_counts(skill_baskets(bridge)).collect() if r.cooccurrence_jobs >= 9)
    got = frequent_pair_counts(bridge, 9, buckets, skill_buckets)
    assert sorted((r.skill_1_key, r.skill_2_key, r.cooccurrence_jobs, r.skill_1_jobs, r.skill_2_jobs)
                  for r in got.collect()) == want and len(want) > 20


def test_rules_from_a_table(spark):
    titles = ["Senior Data Analyst", "data  ENGINEER", "Analyst of data", "Cook", "", None, "C++ data wizard"]
    jobs = spark.createDataFrame([("s", str(i), t, "x") for i, t in enumerate(titles)],
                                 "source string, source_job_id string, job_title_raw string, family string")
    rules = spark.createDataFrame([
        (3, "Any data", r"data", ["data"]), (1, "Analyst", r"\bdata analyst\b", ["analyst", "analysts"]),
        (2, "Engineer", r"\bengineer\b", ["engineer"]), (9, "Plus", r"\+\+", None), (8, "Blank", "^$", [])],
        "rule_no int, family string, pattern string, words array<string>")
    got = {r.source_job_id: (r.role_family, r.rule_no) for r in classify_by_table(jobs, rules).collect()}
    other = ("Non-target Role", None)
    assert [got[str(i)] for i in range(7)] == [("Analyst", 1), ("Engineer", 2), ("Any data", 3), other,
                                               ("Blank", 8), ("Blank", 8), ("Any data", 3)]
    assert rule_problems(rules).isEmpty()
    assert rule_problems(rules.unionByName(rules.limit(1))).count() == 1
