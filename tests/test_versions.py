"""Versions in the catalog, bucketed tables, line landing and the report files."""

import threading

import pytest
from pyspark.sql import functions as F

from postmill import jobs as runs
from postmill.operators.checks import CheckFailed
from postmill.plans import layout, skills, staging, versions, warehouse
from postmill.plans.views import KEY
from postmill.sources import landing, lines


@pytest.fixture()
def database(spark, tmp_path):
    name = f"wh_{abs(hash(str(tmp_path))) % 10 ** 9}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path}/db'")
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


def loaded(spark, n=40):
    from postmill.fixed import MASTER_LAYOUT
    typed = {"is_target_data_role": "true", "role_override_applied": "false", "is_worldwide": "false"}
    columns = [F.expr(typed.get(c, f"concat('{c} ', id % 3)") if t in ("string", "boolean")
                      else f"cast(null as {t})").alias(c) for c, t in MASTER_LAYOUT]
    jobs = spark.range(n).select(F.concat(F.lit("a::"), "id").alias(KEY), *columns[1:], "id").withColumn(
        "source_job_id", F.col("id").cast("string")).drop("id")
    dimension = spark.createDataFrame([("sql", "SQL", "D"), ("r", "R", "D"), ("go", "Go", "D")],
                                      "skill_key string, skill_name string, skill_category string")
    bridge = spark.range(n).filter("id % 4 <> 0").select(
        F.concat(F.lit("a::"), "id").alias(KEY), F.explode(F.expr("slice(array('sql', 'r', 'go'), 1, int(1 + id % 3))"))
        .alias("skill_key"), F.lit("tags").alias("evidence_source"), F.lit("x").alias("matched_aliases"),
        F.lit(1).alias("evidence_field_count"))
    return jobs, dimension, bridge


def test_views_follow_the_version_and_outlive_the_session(spark, tmp_path, database):
    root = str(tmp_path / "wh")
    first = warehouse.publish(spark, root, *loaded(spark), database, 4)
    other = spark.newSession()
    count = f"SELECT sum(job_count) AS n FROM {database}.vw_role_summary"
    assert other.sql(count).first().n == 40
    second = warehouse.publish(spark, root, *loaded(spark, 24), database, 4)
    assert other.sql(count).first().n == 24
    assert {v.name for v in other.catalog.listTables(database)} >= {"vw_skill_demand", "vw_skill_cooccurrence"}
    assert [tuple(r) for r in versions.versions(spark, root).orderBy("version").collect()] == [(1, first), (2, second)]
    assert warehouse.latest_id(spark, root) == second and warehouse.run_mismatch(spark, root).isEmpty()
    assert versions.remove_expired(spark, root, 1) == [first]
    assert other.sql(count).first().n == 24 and warehouse.read_latest(spark, root)["jobs"].count() == 24
    assert not (tmp_path / "wh" / "builds" / first).exists()


def test_two_publishers_cannot_both_win(spark, tmp_path, database):
    root, won, lost = str(tmp_path / "wh"), [], []
    views = {"vw_x": spark.range(3)}

    def publish(run_id):
        try:
            won.append(versions.publish_version(spark, root, database, run_id, 0, views))
        except versions.VersionTaken:
            lost.append(run_id)

    threads = [threading.Thread(target=publish, args=(f"run{i}",)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert won == [1] and len(lost) == 3 and versions.versions(spark, root).count() == 1
    with pytest.raises(versions.VersionTaken):
        versions.publish_version(spark, root, database, "late", 0, views)
    with pytest.raises(ValueError):
        versions.release(spark, root, database, 1)
    versions.claim(spark, database, 2, "died")
    with pytest.raises(versions.VersionTaken):
        versions.publish_version(spark, root, database, "next", 1, views)
    versions.release(spark, root, database, 2)
    assert versions.publish_version(spark, root, database, "again", 1, views) == 2


def test_star_join_needs_no_exchange(spark, tmp_path, database):
    jobs, dimension, bridge = loaded(spark)
    tables = {"jobs": jobs, "job_skills": bridge, "skills": dimension}
    layout.write_bucketed(tables, database, "r-1", str(tmp_path / "b"), 4)
    held = layout.read_bucketed(spark, database, "r-1", tuple(tables))
    audit = skills.skill_audit(held["jobs"], held["skills"], held["job_skills"])
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    want = sorted(map(tuple, skills.skill_audit(jobs, dimension, bridge).collect()), key=repr)
    assert sorted(map(tuple, audit.collect()), key=repr) == want
    # Jobs and skills of jobs are too large to send around; the dictionary is not.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2000")
    try:
        audit = skills.skill_audit(held["jobs"], F.broadcast(held["skills"]), held["job_skills"])
        assert sorted(map(tuple, audit.collect()), key=repr) == want
        plan = audit._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan


LINE = '{{"guid": "j{0}", "title": "Data Analyst", "companyName": "Acme", "pubDate": "1700000000", "description": "SQL", ' \
       '"applicationLink": "http://x", "_source_query": "q {1}", "_source_page": 1, "_collected_at": "2026-01-02T00:00:00Z"}}'


def test_line_batches(spark, tmp_path):
    for stamp, extra in (("20260101_000000", []), ("20260102_000000", ["{broken", '["no object"]'])):
        folder = tmp_path / "feed" / f"batch={stamp}"
        folder.mkdir(parents=True)
        rows = [LINE.format(i % 50, i % 2) for i in range(400)]
        (folder / "part-0.json").write_text("\n".join([*rows[:200], *extra, *rows[200:]]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        batch = lines.read_batch(spark, str(tmp_path / "feed"), lines.PAGED_LINE, str(tmp_path / "out"), "guid")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert batch.stamp == "20260102_000000" and batch.records.count() == 400
    assert sorted(r._malformed for r in batch.malformed.collect()) == ['["no object"]', "{broken"]
    blocks = {r._source_block for r in batch.records.select("_source_block").distinct().collect()}
    assert len(blocks) > 3  # several tasks shared the one file
    got = [r.guid for r in batch.records.orderBy(*lines.LINE_ARRIVAL).collect()]
    assert got == [f"j{i % 50}" for i in range(400)]
    staged = staging.stage_paged(batch.records, "Feed", arrival=lines.LINE_ARRIVAL)
    assert staged.count() == 50 and {r.search_queries for r in staged.collect()} == {"q 0", "q 1"}
    with pytest.raises(CheckFailed, match="malformed"):
        runs.stage_lines_folder(spark, str(tmp_path / "feed"), "Feed", str(tmp_path / "s1"))


def test_bad_line_batches(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        lines.newest_batch(spark, str(tmp_path))
    records = spark.createDataFrame([("", "t")], "guid string, title string")
    lines.write_lines(records, str(tmp_path / "in"), "20260101_000000")
    with pytest.raises(CheckFailed, match="guid"):
        lines.read_batch(spark, str(tmp_path / "in"), lines.PAGED_LINE, str(tmp_path / "o1"), "guid")
    lines.write_lines(records.limit(0), str(tmp_path / "in"), "20260103_000000")
    with pytest.raises((CheckFailed, FileNotFoundError)):
        lines.read_batch(spark, str(tmp_path / "in"), lines.PAGED_LINE, str(tmp_path / "o2"), "guid", "20260103_000000")


def test_reports_are_written(spark, tmp_path):
    jobs, dimension, bridge = loaded(spark)
    human = jobs.limit(6).select("source", "source_job_id", F.lit("Data Analyst").alias("correct_role_family"),
                                 F.lit("Correct").alias("manual_decision"))
    names = runs.report_stage(jobs, dimension, bridge, str(tmp_path), human)
    assert len(names) == 7
    sizes = {n: spark.read.option("header", True).csv(str(tmp_path / n)).count() for n in names}
    assert sizes["skill_audit"] == 40 and sizes["classifier_metrics"] == 1 and sizes["source_reconciliation"] == 3


def test_arrival_order_of_files(spark, tmp_path):
    rows = [(i % 30, i) for i in range(600)]
    spark.createDataFrame(rows, "k int, v int").coalesce(1).write.parquet(str(tmp_path / "t"))
    table = landing.with_arrival(spark.read.parquet(str(tmp_path / "t")))
    assert [r.v for r in table.orderBy(*landing.ARRIVAL).collect()] == list(range(600))
