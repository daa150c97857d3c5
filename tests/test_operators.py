import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postmill.operators import checks, dedup
from postmill.operators.skew import join_group_facts

ROWS = "k string, source string, n int, flag boolean"


def frame(spark, rows, schema=ROWS):
    return spark.createDataFrame(rows, schema)


def keys(df, column="k"):
    return sorted(str(r[column]) for r in df.collect())


def test_keep_first_and_last(spark):
    df = frame(spark, [("a", "x", 2, True), ("a", "y", 1, True), ("b", "z", 3, True), ("a", "w", 3, None)])
    assert sorted((r.k, r.source) for r in dedup.keep_first(df, ["k"], ["n"]).collect()) == [
        ("a", "y"), ("b", "z")]
    assert sorted((r.k, r.source) for r in dedup.keep_last(df, ["k"], ["n"]).collect()) == [
        ("a", "w"), ("b", "z")]
    both = {r.k: r for r in dedup.keep_first_collecting(df, ["k"], ["n"], "source", "seen").collect()}
    assert both["a"].source == "y" and sorted(both["a"].seen) == ["w", "x", "y"]


def test_group_limit_runs_before_the_shuffle(spark):
    df = dedup.keep_first(frame(spark, [("a", "x", 1, True)]), ["k"], ["n"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert plan.index("Final") < plan.index("Exchange hashpartitioning") < plan.index("Partial")


@pytest.mark.parametrize("slices", [1, 3, 64])
def test_duplicate_members_with_a_hot_group(spark, slices):
    rng = random.Random(1)
    data = [("hot" if i % 3 == 0 else rng.choice([None, *map(str, range(150))]), "s", i, True)
            for i in range(400)]
    df = frame(spark, data)
    sizes = dedup.group_sizes(df, ["k"]).filter("group_rows > 1")
    got = join_group_facts(df, sizes, ["k"], ["n"], slices).collect()
    count = Counter(r[0] for r in data)
    assert sorted((r.n, r.k, r.group_rows) for r in got) == sorted(
        (r[2], r[0], count[r[0]]) for r in data if count[r[0]] > 1)
    assert len(got) == dedup.duplicate_members(df, ["k"], ["n"]).count()


@pytest.mark.parametrize("hot", [1, 3])
def test_hot_groups_are_spread(spark, hot):
    df = spark.range(4000).select((F.col("id") % hot).alias("k"), F.col("id").alias("n"))
    sizes = dedup.group_sizes(df, ["k"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = join_group_facts(df, sizes, ["k"], ["n"], 100)
        per_task = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(per_task) == 4000 and max(per_task) < 2500 and len(per_task) > 1


def test_repeat_count(spark):
    df = frame(spark, [("a", "", 1, True), ("a", "", 1, True), (None, "", 1, True), (None, "", 1, True)])
    assert dedup.repeat_count(df, "k").first()[0] == 2
    assert dedup.repeat_count(df.filter("k = 'a'"), "k").first()[0] == 1


def test_columns_and_layout(spark):
    df = frame(spark, [])
    checks.require_columns(df, ["k"], "t")
    checks.require_layout(df, ["k", "source", "n", "flag"], "t")
    with pytest.raises(checks.CheckFailed, match="lacks"):
        checks.require_columns(df, ["k", "zz"], "t")
    with pytest.raises(checks.CheckFailed):
        checks.require_layout(df, ["source", "k", "n", "flag"], "t")
    assert checks.with_optional(df, {"k": "int", "extra": "double"}).dtypes[-1] == ("extra", "double")
    assert checks.missing_views(spark, ["no_such_view"]) == ["no_such_view"]


GOOD = [("a::1", "A", 1, True), ("a::2", "A", 2, False)]
BAD = [("a::1", "A", 1, True), ("a::1", " ", 5, None), ("", "B", 9, False)]


@pytest.mark.parametrize("check, offenders", [
    (lambda d: checks.blank_values(d, ["k", "source"]), ["", "a::1"]),
    (lambda d: checks.duplicate_keys(d, ["k"]), ["a::1"]),
    (lambda d: checks.rule_failures(d, {"small": F.col("n") < 3}).filter("failing_rows > 0")
     .withColumnRenamed("rule", "k"), ["small"]),
    (lambda d: checks.outside_domain(d, "source", ["A"]).withColumnRenamed("source", "k"), [" ", "B"]),
    (lambda d: checks.wrong_source(d, "A").withColumnRenamed("source", "k"), ["", "B"]),
    (lambda d: checks.inverted_range(d.withColumn("hi", F.lit(5)), "n", "hi"), [""]),
    (lambda d: checks.flag_mismatch(d, "flag", F.col("n") == 1), ["a::1"]),
])
def test_checks_pass_and_fail(spark, check, offenders):
    assert check(frame(spark, GOOD)).isEmpty()
    assert keys(check(frame(spark, BAD))) == offenders


def test_not_true_counts_null(spark):
    assert keys(checks.not_true(frame(spark, BAD), "flag")) == ["", "a::1"]


def test_empty_source_is_wrong(spark):
    assert checks.wrong_source(frame(spark, []), "A").count() == 1


def test_ignore_case_keys(spark):
    df = frame(spark, [("SQL", "", 1, True), ("sql", "", 1, True), ("R", "", 1, True)])
    assert checks.duplicate_keys(df, ["k"]).isEmpty()
    assert keys(checks.duplicate_keys(df, ["k"], ignore_case=True)) == ["sql"]


def test_references(spark):
    child = frame(spark, [("a", "", 1, True), ("x", "", 1, True), ("x", "", 2, True), (None, "", 1, True)])
    parent = spark.createDataFrame([("a",)], "id string")
    assert [tuple(r) for r in checks.orphans(child, parent, "k", "id").collect()] == [("x", 2)]
    assert checks.unmatched(child, parent.withColumnRenamed("id", "k"), ["k"]).count() == 3


def test_key_format(spark):
    df = spark.createDataFrame([("a::1", "A", "1"), ("A::2", "A", "2"), (None, "A", "3")],
                               "source_record_key string, source string, source_job_id string")
    assert keys(checks.malformed_keys(df), "source_job_id") == ["2", "3"]


def test_completeness(spark):
    df = frame(spark, [("", "x", None, True), (None, "y", 1, None)])
    got = {r.column_name: (r.missing_rows, r.total_rows)
           for r in checks.completeness(df, ["k", "source", "n"]).collect()}
    assert got == {"k": (2, 2), "source": (0, 2), "n": (1, 2)}


def test_counts_and_sets(spark):
    a, b = spark.range(3), spark.range(2)
    same = checks.count_mismatch(checks.table_counts({"t": a}), checks.table_counts({"t": a}))
    off = checks.count_mismatch(checks.table_counts({"t": a, "u": a}), checks.table_counts({"t": b}))
    assert same.isEmpty() and sorted(r.table_name for r in off.collect()) == ["t", "u"]
    assert [tuple(r) for r in checks.set_difference(a, b).collect()] == [(2, "left")]
    assert checks.dimension_mismatch(a, "id", a.unionByName(a), "id").isEmpty()
    assert checks.dimension_mismatch(b, "id", a, "id").first().side == "right"


def test_assertions(spark):
    checks.assert_empty(spark.range(0), "fine")
    checks.assert_some(spark.range(1), "fine")
    with pytest.raises(checks.CheckFailed, match="bad rows"):
        checks.assert_empty(spark.range(3), "bad rows")
    with pytest.raises(checks.CheckFailed):
        checks.assert_some(spark.range(0), "nothing")
    with pytest.raises(checks.CheckFailed):
        checks.one_row_per_key(frame(spark, BAD), ["k"], "t")
