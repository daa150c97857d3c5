"""Landing files to published warehouse, on small files written here."""

import json
from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from postmill import jobs as runs
from postmill.functions.matching import Skill
from postmill.fixed import MASTER_COLUMNS, PAGED_COLUMNS, SNAPSHOT_COLUMNS
from postmill.operators.checks import CheckFailed
from postmill.plans import gap, master, staging, warehouse
from postmill.sources import landing, tables


def paged_job(guid, title="Data Analyst", **more):
    return {"guid": guid, "title": title, "companyName": "Acme", "pubDate": 1700000000,
            "description": "<p>SQL &amp; Python</p>", "applicationLink": "http://x", **more}


def put(folder, name, jobs, **more):
    (folder / name).write_text(json.dumps({"jobs": jobs, **more}))


@pytest.fixture()
def feed(tmp_path):
    folder = tmp_path / "feed"
    folder.mkdir()
    put(folder, "feed_old_page_001_20260101_000000.json", [paged_job("old")])
    put(folder, "feed_data_analyst_page_001_20260102_000000.json", [
        paged_job(" j1 ", "Data  Analyst", locationRestrictions=["Spain", {"name": "Canada"}],
                  categories=["b", "A", "b"], minSalary=1000, maxSalary=2000.5, currency="usd",
                  salaryPeriod="Annual", seniority=["Senior"]),
        "not an object", None, paged_job("j2", "Cook", locationRestrictions=[])], totalCount=7)
    put(folder, "feed_data_analyst_page_002_20260102_000000.json", [
        paged_job("j3", pubDate="2026-01-01T10:00:00Z", expiryDate="soon", minSalary="many")])
    put(folder, "feed_bi_20260102_000000.json", [paged_job("j1", "BI Analyst"), paged_job("j3")])
    return str(folder)


def test_read_paged(spark, feed):
    rows = {(r.guid.strip(), r._source_query): r for r in landing.read_paged(spark, feed, "feed").collect()}
    assert set(rows) == {("j1", "data analyst"), ("j2", "data analyst"), ("j3", "data analyst"),
                         ("j1", "bi"), ("j3", "bi")}
    assert rows["j3", "data analyst"]._source_page == 2 and rows["j1", "bi"]._source_page == 1
    assert rows["j1", "bi"]._collected_at == "2026-01-02T00:00:00Z"
    assert rows["j2", "data analyst"]._position == 3 and rows["j2", "data analyst"]._total_count == 7
    assert json.loads(rows["j1", "data analyst"].locationRestrictions[1]) == {"name": "Canada"}


def test_stage_paged(spark, feed):
    staged = staging.stage_paged(landing.read_paged(spark, feed, "feed"), "Feed")
    assert tuple(staged.columns) == PAGED_COLUMNS
    rows = {r.source_job_id: r for r in staged.collect()}
    assert set(rows) == {"j1", "j2", "j3"}
    one = rows["j1"]  # the file of query 'bi' sorts first
    assert (one.job_title_raw, one.search_queries, one.role_family) == (
        "BI Analyst", "bi|data analyst", "BI Analyst")
    two = rows["j2"]
    assert (two.location_raw, two.is_worldwide, two.is_target_data_role) == ("Worldwide", True, False)
    assert two.publication_date == datetime(2023, 11, 14, 22, 13, 20)
    assert two.description_text == "SQL & Python" and two.salary_raw == ""
    assert staging.query_overlap(staged).count() == 2
    assert [r.source_job_id for r in staged.orderBy(*staging.newest_first()).collect()][0] in rows
    report = staging.staging_report(landing.read_paged(spark, feed, "feed"), staged).first()
    assert (report.records_received, report.unique_jobs, report.repeated_records) == (5, 3, 2)


def test_stage_values(spark, feed):
    records = landing.read_paged(spark, feed, "feed").filter("_source_query = 'data analyst'")
    rows = {r.source_job_id: r for r in staging.stage_paged(records, "Feed").collect()}
    one, three = rows["j1"], rows["j3"]
    assert (one.job_title_raw, one.location_raw, one.tags) == ("Data Analyst", "Canada|Spain", "A|b")
    assert (one.salary_raw, one.salary_currency) == ("1,000–2,000.50 USD per annual", "USD")
    assert (one.seniority_raw, one.job_type, one.is_worldwide) == ("Senior", "", False)
    assert three.publication_date == datetime(2026, 1, 1, 10) and three.expiry_date is None
    assert three.salary_min is None and three.location_raw == ""
    ms = staging.stage_paged(records, "Feed", epoch_unit="ms").filter("source_job_id = 'j1'").first()
    assert ms.publication_date == datetime(1970, 1, 20, 16, 13, 20)


def test_bad_landing_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        landing.read_paged(spark, str(tmp_path), "feed")
    put(tmp_path, "feed_a_page_001_20260101_000000.json", {"not": "a list"})
    with pytest.raises(CheckFailed, match="jobs array"):
        landing.read_paged(spark, str(tmp_path), "feed")
    put(tmp_path, "feed_a_page_001_20260102_000000.json", [])
    with pytest.raises(CheckFailed, match="no records"):
        landing.read_paged(spark, str(tmp_path), "feed")
    put(tmp_path, "feed_a_page_001_20260103_000000.json", [paged_job(" ")])
    with pytest.raises(CheckFailed, match="guid"):
        landing.read_paged(spark, str(tmp_path), "feed")
    put(tmp_path, "feed_a.json", [paged_job("x")])
    with pytest.raises(PySparkException, match="unexpected file name"):
        landing.read_paged(spark, str(tmp_path), "feed")


SNAPSHOT = {"url": "u", "company_name": "Acme ", "company_logo": "l", "category": "Data",
            "tags": ["b", "A", "a"], "job_type": "Full_Time", "publication_date": "2026-01-05T01:02:03",
            "candidate_required_location": " Spain", "salary": "", "description": "<b>ETL</b> work"}


@pytest.fixture()
def snap(tmp_path):
    folder = tmp_path / "snap"
    folder.mkdir()
    put(folder, "snap_20260101_000000.json", [{"id": 1, "title": "Old", **SNAPSHOT}])
    put(folder, "snap_20260103_010203.json",
        [{"id": 5, "title": "First", **SNAPSHOT}, {"id": 5, "title": "Data Engineer", **SNAPSHOT},
         {"id": 6, "title": "Cook", **SNAPSHOT}], **{"job-count": 3, "total-job-count": 9})
    return str(folder)


def test_stage_snapshot(spark, snap):
    records = landing.read_snapshot(spark, snap, "snap")
    assert {(r._job_count, r._total_job_count) for r in records.collect()} == {(3, 9)}
    staged = staging.stage_snapshot(records, "Snap")
    assert tuple(staged.columns) == SNAPSHOT_COLUMNS
    rows = {r.source_job_id: r for r in staged.collect()}
    five = rows["5"]  # the later record wins
    assert (five.job_title_raw, five.tags, five.job_type) == ("Data Engineer", "A|a|b", "full_time")
    assert (five.company_name, five.location_raw, five.job_url) == ("Acme", "Spain", "u")
    assert five.collected_at == "2026-01-03T01:02:03Z" and set(rows) == {"5", "6"}


def test_existing_renamed_column_does_not_collide(spark, snap):
    records = landing.read_snapshot(spark, snap, "snap").withColumn("company_logo_url", F.lit("old"))
    assert staging.stage_snapshot(records, "Snap").first().company_logo_url == "l"


def crawl(spark, *pages):
    rows = [(q, p, i) for q, p, ids in pages for i in ids]
    return spark.createDataFrame(rows, "_source_query string, _source_page int, source_job_id string")


def test_crawl_stops_at_nothing_new_and_at_gaps(spark):
    records = crawl(spark, ("a", 1, "xyx"), ("a", 2, "xz"), ("a", 3, "zz"), ("a", 4, "new"),
                    ("b", 1, "x"), ("b", 3, "q"))
    got = {(r._source_query, r._source_page): (r.page_records, r.new_ids, r.counted)
           for r in staging.crawl_pages(records).collect()}
    assert got == {("a", 1): (3, 2, True), ("a", 2): (2, 1, True), ("a", 3): (2, 0, False),
                   ("a", 4): (3, 3, False), ("b", 1): (1, 1, True), ("b", 3): (1, 1, False)}
    per = {r._source_query: tuple(r)[1:] for r in staging.crawl_summary(records).collect()}
    assert per == {"a": (2, 5, 3, 2), "b": (1, 1, 1, 0)}
    assert tuple(staging.crawl_totals(records).first()) == (3, 6, 3, 3)


@pytest.fixture()
def staged(spark, feed, snap, tmp_path):
    return {"Feed": runs.stage_paged_folder(spark, feed, "feed", "Feed", str(tmp_path / "s1")),
            "Snap": runs.stage_snapshot_folder(spark, snap, "snap", "Snap", str(tmp_path / "s2"))}


def test_master(spark, staged):
    table = master.build_master(staged)
    assert tuple(table.columns) == MASTER_COLUMNS
    assert {r.source_record_key for r in table.collect()} == {
        "feed::j1", "feed::j2", "feed::j3", "snap::5", "snap::6"}
    snap_row = table.filter("source = 'Snap'").first()
    assert snap_row.is_worldwide is None and snap_row.search_queries is None
    assert table.orderBy(*master.master_order()).first().source == "Snap"
    report = {r.source: tuple(r)[1:] for r in master.source_reconciliation(table).collect()}
    assert report == {"Feed": (3, 2, 1, 0, 0, 3, 0), "Snap": (2, 1, 1, 0, 0, 2, 0)}
    with pytest.raises(CheckFailed, match="wrong source"):
        master.build_master({"Other": staged["Feed"]})
    with pytest.raises(CheckFailed, match="repeated"):
        master.build_master({"Feed": staged["Feed"].unionByName(staged["Feed"])})


def test_master_reads_text_columns(spark, staged, tmp_path):
    """A source that arrives as CSV text conforms to the same typed table."""
    path = str(tmp_path / "csv")
    tables.write_csv(staged["Feed"].withColumn("description_text", F.lit('say "hi",\nNA')), path)
    back = tables.read_csv(spark, path)
    assert set(dict(back.dtypes).values()) == {"string"}
    typed = master.conform(back)
    assert dict(typed.dtypes)["is_worldwide"] == "boolean" and typed.count() == 3
    row = typed.filter("source_job_id = 'j2'").first()
    assert row.is_worldwide is True and row.publication_date == datetime(2023, 11, 14, 22, 13, 20)
    assert row.description_text == 'say "hi",\nNA'


def test_duplicates(spark):
    rows = [("A", "1", "f1"), ("A", "2", "f1"), ("A", "3", "f2"), ("B", "4", "f2"), ("B", "5", ""),
            ("B", "6", " "), ("A", "7", "f3"), ("B", "8", None)]
    table = spark.createDataFrame(rows, "source string, source_job_id string, job_fingerprint string")
    table = table.withColumns({c: F.lit("x") for c in master.DUPLICATE_COLUMNS if c not in table.columns
                               and c not in ("duplicate_scope", "record_count", "source_count")})
    got = master.duplicate_candidates(table).orderBy(*master.duplicate_order())
    assert tuple(got.columns) == master.DUPLICATE_COLUMNS
    assert [(r.duplicate_scope, r.job_fingerprint, r.record_count, r.source_count, r.source_job_id)
            for r in got.collect()] == [
        ("Cross-source", "f2", 2, 2, "3"), ("Cross-source", "f2", 2, 2, "4"),
        ("Within-source", "f1", 2, 1, "1"), ("Within-source", "f1", 2, 1, "2")]
    assert {tuple(r) for r in master.duplicate_groups(table).collect()} == {
        ("Cross-source", 1, 2), ("Within-source", 1, 2)}


def test_run_all_and_publish(spark, staged, tmp_path):
    work = str(tmp_path / "work")
    skills = (Skill("sql", "SQL", "Q", ("SQL",)), Skill("etl", "ETL", "E", ("ETL",)))
    run_id = runs.run_all(spark, work, staged, skills)
    root = f"{work}/warehouse"
    built = warehouse.read_latest(spark, root)
    assert warehouse.latest_run(spark, root).first().run_id == run_id
    assert {t: df.count() for t, df in built.items()} == {
        "sources": 2, "jobs": 3, "skills": 2, "job_skills": 3}
    row = warehouse.latest_run(spark, root).first()
    assert (row.sources_loaded, row.jobs_loaded, row.skills_loaded, row.job_skills_loaded) == (2, 3, 2, 3)
    assert warehouse.run_mismatch(spark, root).isEmpty()
    assert built["jobs"].filter("salary_raw = ''").isEmpty()
    got = spark.sql("select skill_key, job_count, job_share_pct from vw_skill_demand order by 1").collect()
    assert [tuple(r) for r in got] == [("etl", 1, 33.33), ("sql", 2, 66.67)]
    assert spark.sql("select count(*) from vw_role_skill_demand").first()[0] == 3

    baskets = warehouse.read_baskets(spark, root, run_id)
    best = gap.next_skills(built["jobs"], built["skills"], baskets, ["sql"], "Data Engineer").collect()
    assert [(r.skill_key, r.marginal_coverage_gain_pct_points) for r in best] == [("etl", 100.0)]

    bad = built["job_skills"].withColumn("skill_key", F.lit("ghost"))
    with pytest.raises(CheckFailed, match="unknown skill keys"):
        warehouse.publish(spark, root, built["jobs"], built["skills"], bad)
    assert warehouse.runs(spark, root).count() == 1  # a failed build stays invisible


@pytest.mark.parametrize("change, message", [
    ({"jobs": lambda d: d.withColumn("is_target_data_role", F.lit(False))}, "only target rows"),
    ({"jobs": lambda d: d.withColumns({"salary_min": F.lit(5.0), "salary_max": F.lit(1.0)})}, "salary range"),
    ({"jobs": lambda d: d.unionByName(d)}, "repeated"),
    ({"jobs": lambda d: d.withColumn("job_title_raw", F.lit(" "))}, "job_title_raw present"),
    ({"jobs": lambda d: d.limit(0)}, "unknown job keys"),
    ({"skills": lambda d: d.drop("skill_name")}, "skills has columns"),
    ({"job_skills": lambda d: d.withColumn("evidence_field_count", F.lit(0))}, "evidence counted")])
def test_publish_rejects(spark, staged, tmp_path, change, message):
    table = master.target_rows(master.build_master(staged, verify=False))
    parts = {"jobs": table,
             "skills": spark.createDataFrame([("sql", "SQL", "Q")], "skill_key string, skill_name string, "
                                                                    "skill_category string"),
             "job_skills": table.select("source_record_key", F.lit("sql").alias("skill_key"),
                                        F.lit("tags").alias("evidence_source"),
                                        F.lit("SQL").alias("matched_aliases"),
                                        F.lit(1).alias("evidence_field_count"))}
    for name, f in change.items():
        parts[name] = f(parts[name])
    with pytest.raises(CheckFailed, match=message):
        warehouse.publish(spark, str(tmp_path / "w"), parts["jobs"], parts["skills"], parts["job_skills"])


def test_nothing_found_is_an_error(spark, staged, tmp_path):
    target = master.target_rows(master.build_master(staged, verify=False))
    with pytest.raises(CheckFailed, match="no skill"):
        runs.skill_stage(target, str(tmp_path / "b"), (Skill("x", "X", "Y", ("zzz",)),))


def test_human_tables(spark, tmp_path):
    def csv(name, text):
        (tmp_path / name).write_text(text, encoding="utf-8")
        return str(tmp_path / name)

    skills = tables.load_skills(spark, csv("d.csv", "﻿skill_key,skill_name,skill_category,aliases\n"
                                                   "sql,SQL,Q,SQL| T-SQL|\nr,R,P,\"R, language\"\n"))
    assert sorted((r.skill_key, r.aliases) for r in skills.collect()) == [("r", "R, language"), ("sql", "SQL| T-SQL|")]
    for text in ("sql,SQL,Q,\n", "sql,SQL,Q,a\nsql,X,Q,b\n", "a,SQL,Q,a\nb,sql,Q,b\n", "a,A,Q,|\n"):
        with pytest.raises(CheckFailed):
            tables.load_skills(spark, csv("bad.csv", "skill_key,skill_name,skill_category,aliases\n" + text))

    assert tables.load_role_overrides(spark, str(tmp_path / "none.csv"), "Feed") is None
    human = tables.load_role_overrides(
        spark, csv("o.csv", "source_job_id,correct_role_family,is_target\n j1 ,BI Analyst,False\n"), "Feed")
    assert [tuple(r) for r in human.collect()] == [("Feed", "j1", "BI Analyst", "")]
    assert tables.load_skill_overrides(spark, str(tmp_path / "none.csv")) is None
    out = tables.load_skill_overrides(
        spark, csv("s.csv", "source_record_key,skill_key,override_action,reason,\nk,sql,exclude,\"a, b\",\n"))
    assert out.first().reason == "a, b"
    with pytest.raises(CheckFailed):
        tables.load_skill_overrides(
            spark, csv("t.csv", "source_record_key,skill_key,override_action,reason\nk,sql,keep,x\n"))
    head = "source_job_id,job_title_raw,manual_decision,correct_role_family,review_notes\n"
    assert tables.load_reviews(spark, csv("r.csv", head + "1,T,Correct,BI Analyst,\n2,T,Expired link,,\n")).count() == 1
    with pytest.raises(CheckFailed):
        tables.load_reviews(spark, csv("q.csv", head + "1,T,Correct,,\n"))


def test_subset_sink(spark, tmp_path):
    df = spark.range(10).select(F.col("id"), (F.col("id") > 6).alias("flag"))
    full, part = str(tmp_path / "f"), str(tmp_path / "p")
    tables.write_with_subset(df, F.col("flag"), full, part, ["id"])
    assert spark.read.parquet(full).count() == 10 and spark.read.parquet(part).count() == 3
