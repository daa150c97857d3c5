"""Role classification, its review loop and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.fixed import (AUTOMATED, DECISION_ALIASES, DECISIONS, MANUAL, NON_TARGET,
                            ROLE_ALIASES, ROLE_FAMILIES,
                            ROLE_RULES, UNVERIFIED)
from postmill.functions.roles import Rules, review_priority, review_reason, with_rule_family
from postmill.functions.text import strip
from postmill.functions.values import ratio
from postmill.operators import checks

JOB_ID = ["source", "source_job_id"]


def clean_overrides(overrides: DataFrame, default_source: str) -> DataFrame:
    """Trim, and fill in the columns older override files lack."""
    checks.require_columns(overrides, ["source_job_id", "correct_role_family"], "role overrides")
    filled = checks.with_optional(overrides, {"manual_decision": "string"})
    if "source" not in filled.columns:
        filled = filled.withColumn("source", F.lit(default_source))
    return filled.select(strip(F.col("source")).alias("source"),
                         strip(F.col("source_job_id")).alias("source_job_id"),
                         strip(F.col("correct_role_family")).alias("correct_role_family"),
                         F.coalesce("manual_decision", F.lit("")).alias("manual_decision"))


def check_overrides(overrides: DataFrame, families=ROLE_FAMILIES) -> DataFrame:
    """Fail on unknown families or repeated keys; else return the overrides."""
    checks.assert_empty(checks.outside_domain(overrides, "correct_role_family", families),
                        "unknown override families")
    return checks.one_row_per_key(overrides, JOB_ID, "role overrides")


def classify_roles(jobs: DataFrame, overrides: DataFrame | None = None,
                   rules: Rules = ROLE_RULES) -> DataFrame:
    """Rule family, then the verified human family where there is one.

    `overrides` has one row per (source, source_job_id). It is not hinted: the
    planner broadcasts it while it is small and shuffles it when it is not.
    """
    checks.require_columns(jobs, [*JOB_ID, "job_title_raw"], "classification input")
    ruled = with_rule_family(jobs.withColumns({c: strip(F.col(c)) for c in JOB_ID}),
                             "job_title_raw", "automated_role_family", rules)
    if overrides is None:
        joined = ruled.withColumns({"correct_role_family": F.lit(None).cast("string"),
                                    "manual_decision": F.lit(None).cast("string")})
    else:
        joined = ruled.join(overrides.select(*JOB_ID, "correct_role_family", "manual_decision"),
                            JOB_ID, "left")
    corrected = F.col("correct_role_family").isNotNull()
    return (joined
            .withColumn("role_family", F.coalesce("correct_role_family", "automated_role_family"))
            .withColumns({
                "classification_method": F.when(corrected, MANUAL)
                                          .otherwise(AUTOMATED),
                "role_override_applied": corrected,
                "override_decision": F.when(corrected, F.coalesce("manual_decision", F.lit("")))
                                      .otherwise(""),
                "is_target_data_role": F.col("role_family") != NON_TARGET})
            .drop("correct_role_family", "manual_decision"))


def changed_predictions(classified: DataFrame) -> DataFrame:
    return classified.agg(F.count_if(F.col("automated_role_family") != F.col("role_family"))
                          .alias("changed_predictions"))


def review_queue(classified: DataFrame) -> DataFrame:
    """Classified postings a person should look at, with blanks to fill in."""
    needed = ["source_job_id", "job_title_raw", "role_family", "is_target_data_role",
              "company_name", "search_queries", "job_url"]
    checks.require_columns(classified, needed, "review input")
    reason = review_reason(F.col("role_family"), F.col("job_title_raw"))
    blanks = [F.lit("").alias(c) for c in ("manual_decision", "correct_role_family",
                                           "review_notes")]
    return (classified.withColumn("review_reason", reason)
            .withColumn("review_priority", review_priority(F.col("review_reason")))
            .filter(F.col("review_priority") != "No review")
            .select("review_priority", "review_reason", "source_job_id", "job_title_raw",
                    "role_family", "is_target_data_role", "company_name", "search_queries",
                    *blanks, "job_url"))


def review_order() -> list:
    """Order of the review file: High before Medium, then family, title, id."""
    return [F.when(F.col("review_priority") == "High", 1).otherwise(2), F.col("role_family"),
            F.col("job_title_raw"), F.col("source_job_id")]


def reviewed_rows(audit: DataFrame) -> DataFrame:
    """The filled-in review table, trimmed, with known misspellings mapped."""
    columns = ["source_job_id", "job_title_raw", "manual_decision", "correct_role_family",
               "review_notes"]
    checks.require_columns(audit, columns, "review table")
    clean = audit.select(*[strip(F.col(c)).alias(c) for c in columns])
    return (clean.replace(DECISION_ALIASES, subset=["manual_decision"])
            .replace(ROLE_ALIASES, subset=["correct_role_family"]))


def review_problems(audit: DataFrame, families=ROLE_FAMILIES) -> DataFrame:
    """(problem, value, problem_rows): what must be repaired before overrides can be made."""
    rows = reviewed_rows(audit)
    verified = rows.filter(F.col("manual_decision") != UNVERIFIED)

    def tagged(found: DataFrame, problem: str, value: str, count: str) -> DataFrame:
        return found.select(F.lit(problem).alias("problem"), F.col(value).alias("value"),
                            F.col(count).alias("problem_rows"))

    blank = (verified.filter(F.col("correct_role_family") == "")
             .groupBy("job_title_raw").agg(F.count("*").alias("n")))
    named = verified.filter(F.col("correct_role_family") != "")
    return (tagged(checks.outside_domain(rows, "manual_decision", DECISIONS),
                   "invalid decision", "manual_decision", "value_rows")
            .unionByName(tagged(blank, "missing role family", "job_title_raw", "n"))
            .unionByName(tagged(checks.outside_domain(named, "correct_role_family", families),
                                "invalid role family", "correct_role_family", "value_rows"))
            .unionByName(tagged(checks.duplicate_keys(verified, ["source_job_id"]),
                                "repeated job id", "source_job_id", "key_rows")))


def prepare_overrides(audit: DataFrame) -> DataFrame:
    """Override table from the verified rows of a review table.

    Run `review_problems` first (the loader does); rows are taken as valid.
    """
    return (reviewed_rows(audit).filter(F.col("manual_decision") != UNVERIFIED)
            .select("source_job_id", "job_title_raw", "manual_decision", "correct_role_family",
                    (F.col("correct_role_family") != NON_TARGET)
                    .alias("is_target_data_role_override"), "review_notes"))


def labelled_predictions(overrides: DataFrame, staged: DataFrame) -> DataFrame:
    """Human labels beside the automated family of the same posting.

    Labels without a posting are found by `checks.unmatched`.
    """
    columns = ["job_title_raw", "company_name", "automated_role_family"]
    posts = staged.select(*[strip(F.col(c)).alias(c) for c in JOB_ID], *columns)
    return overrides.join(posts, JOB_ID).withColumns({
        "exact_family_match": F.col("automated_role_family") == F.col("correct_role_family"),
        "predicted_is_target": F.col("automated_role_family") != NON_TARGET,
        "actual_is_target": F.col("correct_role_family") != NON_TARGET})


def evaluate(overrides: DataFrame, staged: DataFrame, strict: bool = True) -> DataFrame:
    """labelled_predictions after the checks of an evaluation run.

    With `strict`, a reviewed posting that is no longer staged is an error;
    otherwise it is left out.
    """
    check_overrides(overrides)
    checks.one_row_per_key(staged, JOB_ID, "staged postings")
    if strict:
        checks.assert_empty(checks.unmatched(overrides, staged, JOB_ID),
                            "reviewed postings missing from staging")
    return labelled_predictions(overrides, staged)


def classifier_metrics(evaluated: DataFrame) -> DataFrame:
    """Family accuracy and target precision, recall and F1, in one row."""
    said, true = F.col("predicted_is_target"), F.col("actual_is_target")
    counts = evaluated.agg(
        F.count("*").alias("reviewed_records"),
        F.count_if("exact_family_match").alias("exact_role_family_matches"),
        F.count_if(~F.col("exact_family_match")).alias("exact_role_family_mismatches"),
        F.count_if(said & true).alias("true_positive"),
        F.count_if(said & ~true).alias("false_positive"),
        F.count_if(~said & true).alias("false_negative"),
        F.count_if(~said & ~true).alias("true_negative"))

    def share(part: str, *whole: str):
        total = sum((F.col(w) for w in whole), F.lit(0))
        return F.coalesce(ratio(F.col(part), total), F.lit(0.0))

    precision, recall = F.col("target_precision"), F.col("target_recall")
    return (counts
            .withColumn("role_family_accuracy",
                        share("exact_role_family_matches", "reviewed_records"))
            .withColumn("target_precision", share("true_positive", "true_positive",
                                                  "false_positive"))
            .withColumn("target_recall", share("true_positive", "true_positive",
                                               "false_negative"))
            .withColumn("target_f1_score", F.coalesce(
                ratio(F.lit(2.0) * precision * recall, precision + recall), F.lit(0.0)))
            .select("reviewed_records", "exact_role_family_matches",
                    "exact_role_family_mismatches", "role_family_accuracy", "true_positive",
                    "false_positive", "false_negative", "true_negative", "target_precision",
                    "target_recall", "target_f1_score"))


def classifier_mismatches(evaluated: DataFrame) -> DataFrame:
    """Labels whose family the rules missed."""
    return (evaluated.filter(~F.col("exact_family_match"))
            .select("source_job_id", "job_title_raw", "company_name", "automated_role_family",
                    "correct_role_family", "manual_decision", "predicted_is_target",
                    "actual_is_target")
            .orderBy("correct_role_family", "job_title_raw", "source_job_id"))
