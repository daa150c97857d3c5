import pytest
from pyspark.sql import functions as F

from postmill.operators.checks import CheckFailed
from postmill.plans import classify as c

# Titles and the families they must get.
CASES = {
    "Senior Data Analyst": "Data Analyst", "Lead Data Engineer": "Data Engineer",
    "Senior Data Scientist": "Data Scientist", "Analytics Engineer": "Analytics Engineer",
    "Power BI Developer": "BI Developer", "Business Intelligence Analyst": "BI Analyst",
    "Business Analyst": "Business Analyst", "Analytics Director": "Analytics Manager",
    "Backend Software Engineer": "Non-target Role", "data \n ANALYST": "Data Analyst",
    "Clin Bus Intellig Analyst-Sr": "BI Analyst", "Director, Growth Analytics": "Analytics Manager",
    "Senior Data Analytics Specialist": "Data Analyst", "Machine Learning Data Engineer": "Data Engineer",
    "Web Analytics": "Other Analytics", "Database Analyst": "Non-target Role", "": "Non-target Role",
}


def jobs(spark, titles, source="A"):
    return spark.createDataFrame([(f" {source} ", f"{i} ", t) for i, t in enumerate(titles)],
                                 "source string, source_job_id string, job_title_raw string")


def test_title_rules(spark):
    got = c.classify_roles(jobs(spark, CASES)).collect()
    assert {r.job_title_raw: r.role_family for r in got} == CASES
    assert all(r.is_target_data_role == (r.role_family != "Non-target Role") for r in got)
    assert {(r.source, r.classification_method, r.override_decision) for r in got} == {
        ("A", "Automated Rule", "")}


def test_missing_title_is_non_target(spark):
    row = c.classify_roles(jobs(spark, [None])).first()
    assert row.role_family == "Non-target Role"


def overrides(spark, rows):
    raw = spark.createDataFrame(rows, "source_job_id string, correct_role_family string, "
                                      "manual_decision string")
    return c.clean_overrides(raw, "A")


def test_overrides_win(spark):
    human = overrides(spark, [("0", "BI Analyst ", "Incorrect Role Family"),
                              ("1", "Non-target Role", None), ("9", "Data Analyst", "Correct")])
    got = {r.source_job_id: r for r in c.classify_roles(
        jobs(spark, ["Data Analyst", "Data Engineer", "Data Scientist"]),
        c.check_overrides(human)).collect()}
    assert (got["0"].role_family, got["0"].automated_role_family) == ("BI Analyst", "Data Analyst")
    assert got["0"].classification_method == "Manual Override"
    assert (got["1"].is_target_data_role, got["1"].override_decision) == (False, "")
    assert got["2"].role_override_applied is False and len(got) == 3
    classified = c.classify_roles(jobs(spark, ["Data Analyst", "Data Engineer"]), human)
    assert c.changed_predictions(classified).first()[0] == 2


def test_override_of_other_source_is_ignored(spark):
    human = overrides(spark, [("0", "BI Analyst", "Correct")])
    assert c.classify_roles(jobs(spark, ["Data Analyst"], "B"), human).first().role_family == "Data Analyst"


@pytest.mark.parametrize("rows", [[("0", "Chef", "Correct")],
                                  [("0", "BI Analyst", ""), (" 0", "BI Analyst", "")]])
def test_bad_overrides_fail(spark, rows):
    with pytest.raises(CheckFailed):
        c.check_overrides(overrides(spark, rows))


def test_missing_columns_fail(spark):
    with pytest.raises(CheckFailed):
        c.classify_roles(spark.range(1))


def test_review_queue(spark):
    rows = [("1", "Business Analyst", "Business Analyst"), ("2", "Data Wizard", "Non-target Role"),
            ("3", "Cook", "Data Analyst"), ("4", "Data Analyst", "Data Analyst"),
            ("5", "Cook", "Other Analytics"), ("6", "Cook", "Non-target Role")]
    frame = spark.createDataFrame(rows, "source_job_id string, job_title_raw string, role_family string")
    frame = frame.withColumns({n: F.lit("x") for n in ("company_name", "search_queries", "job_url")})
    queue = c.review_queue(frame.withColumn("is_target_data_role", F.lit(True))).orderBy(*c.review_order())
    assert [(r.source_job_id, r.review_priority, r.review_reason) for r in queue.collect()] == [
        ("3", "High", "Possible false positive"), ("2", "High", "Possible false negative"),
        ("5", "High", "Ambiguous standardized role | Possible false positive"),
        ("1", "Medium", "Ambiguous standardized role")]


AUDIT = "source_job_id string, job_title_raw string, manual_decision string, " \
        "correct_role_family string, review_notes string"


def test_prepare_overrides(spark):
    audit = spark.createDataFrame([
        ("1", "T1", "Correct ", "Analytics engineer", None), ("2", "T2", "Expired link", "", ""),
        ("3", "T3", "False Positive", "Non-target Role", "n"), ("4", "T4", "Unverified", "Chef", "")], AUDIT)
    assert c.review_problems(audit).isEmpty()
    got = c.prepare_overrides(audit).orderBy("source_job_id").collect()
    assert [(r.source_job_id, r.correct_role_family, r.is_target_data_role_override, r.review_notes)
            for r in got] == [("1", "Analytics Engineer", True, ""), ("3", "Non-target Role", False, "n")]


def test_review_problems(spark):
    audit = spark.createDataFrame([
        ("1", "T1", "Good", "Data Analyst", ""), ("2", "T2", "Correct", " ", ""),
        ("3", "T3", "Correct", "Chef", ""), ("4", "T4", "Correct", "BI Analyst", ""),
        ("4", "T4", "Correct", "BI Analyst", "")], AUDIT)
    assert {(r.problem, r.value) for r in c.review_problems(audit).collect()} == {
        ("invalid decision", "Good"), ("missing role family", "T2"),
        ("invalid role family", "Chef"), ("repeated job id", "4")}


def evaluated(spark, rows):
    staged = spark.createDataFrame(
        [("A", str(i), said, "T", "C", true, "d") for i, (said, true) in enumerate(rows)],
        ["source", "source_job_id", "automated_role_family", "job_title_raw", "company_name",
         "correct_role_family", "manual_decision"])
    labels = staged.select("source", "source_job_id", "correct_role_family", "manual_decision")
    return c.labelled_predictions(labels, staged.drop("correct_role_family", "manual_decision"))


def test_metrics_of_recorded_review(spark):
    target, other, non = "Data Analyst", "BI Analyst", "Non-target Role"
    rows = ([(target, target)] * 16 + [(target, other)] * 6 + [(target, non)] + [(non, target)] * 4)
    m = c.classifier_metrics(evaluated(spark, rows)).first()
    assert tuple(m)[:3] == (27, 16, 11)
    assert (m.true_positive, m.false_positive, m.false_negative, m.true_negative) == (22, 1, 4, 0)
    assert m.role_family_accuracy == pytest.approx(0.5925925925925926)
    assert m.target_precision == pytest.approx(0.9565217391304348)
    assert m.target_recall == pytest.approx(0.8461538461538461)
    assert m.target_f1_score == pytest.approx(0.8979591836734695)
    assert c.classifier_mismatches(evaluated(spark, rows)).count() == 11


def test_evaluation_needs_every_label(spark):
    staged = c.classify_roles(jobs(spark, ["Data Analyst"])).withColumn("company_name", F.lit("C"))
    human = overrides(spark, [("0", "Data Analyst", "Correct"), ("7", "BI Analyst", "Correct")])
    with pytest.raises(CheckFailed, match="missing from staging"):
        c.evaluate(human, staged)
    assert c.classifier_metrics(c.evaluate(human, staged, strict=False)).first()[0] == 1


def test_metrics_without_targets_are_zero(spark):
    m = c.classifier_metrics(evaluated(spark, [("Non-target Role", "Non-target Role")])).first()
    assert (m.target_precision, m.target_recall, m.target_f1_score, m.true_negative) == (0, 0, 0, 1)
