"""The whole run, stage by stage, with Parquet between the stages.

Each stage writes its table and the next one reads it back: lineage ends
there, so a lost executor costs one stage's tasks and never the whole chain.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from postmill.functions.matching import STUDY_FIELD_RULE, ContextRule, Skill
from postmill.operators import checks
from postmill.plans import master as masters
from postmill.plans import skills as skilled
from postmill.plans import classify, staging, warehouse
from postmill.plans.skill_index import extract_skills_joined
from postmill.plans.views import KEY
from postmill.sources import landing, lines, tables


def _stage(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def stage_paged_folder(spark: SparkSession, folder: str, prefix: str, source: str, out: str,
                       overrides: DataFrame | None = None, epoch_unit: str = "s") -> DataFrame:
    records = landing.read_paged(spark, folder, prefix)
    return _stage(staging.stage_paged(records, source, overrides, epoch_unit), out)


def stage_snapshot_folder(spark: SparkSession, folder: str, prefix: str, source: str, out: str,
                          overrides: DataFrame | None = None) -> DataFrame:
    records = landing.read_snapshot(spark, folder, prefix)
    return _stage(staging.stage_snapshot(records, source, overrides), out)


def master_stage(sources: Mapping[str, DataFrame], out: str) -> DataFrame:
    """Write the master table, then check its keys on what was written."""
    for name, df in sources.items():
        masters.check_source(df, name)
    table = _stage(masters.build_master(sources, verify=False), out)
    return checks.one_row_per_key(table, [KEY], "master")


def skill_stage(jobs: DataFrame, out: str,
                skills: Sequence[Skill] | DataFrame = skilled.DEFAULT_SKILLS,
                exclusions: DataFrame | None = None,
                rules: Sequence[ContextRule] = (STUDY_FIELD_RULE,)) -> DataFrame:
    """Write the bridge of the target jobs; finding nothing at all is an error.

    A dictionary given as a table, of any size, is joined; a sequence is a constant."""
    skilled.check_extraction_input(jobs)
    extract = (extract_skills_joined if isinstance(skills, DataFrame)
               else skilled.extract_skills)
    bridge = _stage(extract(jobs, skills, rules), f"{out}/first_pass")
    checks.assert_some(bridge, "no skill was found in any posting")
    checks.one_row_per_key(bridge, [KEY, "skill_key"], "job skills")
    kept = bridge if exclusions is None else skilled.apply_exclusions(bridge, exclusions)
    return _stage(kept, f"{out}/final")


def stage_lines_folder(spark: SparkSession, folder: str, source: str, out: str,
                       overrides: DataFrame | None = None, epoch_unit: str = "s") -> DataFrame:
    """As stage_paged_folder from a folder of line batches; malformed lines are an error."""
    batch = lines.read_batch(spark, folder, lines.PAGED_LINE, f"{out}/records", "guid")
    checks.assert_empty(batch.malformed, f"malformed lines in batch {batch.stamp}")
    return _stage(staging.stage_paged(batch.records, source, overrides, epoch_unit,
                                      lines.LINE_ARRIVAL), f"{out}/staged")


def report_stage(master: DataFrame, dimension: DataFrame, bridge: DataFrame, out: str,
                 overrides: DataFrame | None = None) -> list[str]:
    """Write the reports of a run as sorted CSV; returns their names.

    Master: duplicates and reconciliation. Skills: audit of every target job and review
    sample. Roles: review queue, and with human `overrides` metrics and mismatches.
    """
    target = masters.target_rows(master)
    audit = skilled.skill_audit(target, dimension, bridge)
    reports = {
        "duplicate_candidates": (masters.duplicate_candidates(master), masters.duplicate_order()),
        "source_reconciliation": (masters.source_reconciliation(master), ["source"]),
        "skill_audit": (audit, skilled.audit_order()),
        "skill_review_sample": (skilled.skill_audit_sample(target, dimension, bridge),
                                ["audit_type", KEY, "skill_key"]),
        "role_review_queue": (classify.review_queue(master), classify.review_order())}
    if overrides is not None:
        evaluated = classify.labelled_predictions(overrides, master)
        reports |= {"classifier_metrics": (classify.classifier_metrics(evaluated), []),
                    "classifier_mismatches": (classify.classifier_mismatches(evaluated), [])}
    for name, (frame, order) in reports.items():
        tables.write_csv(frame, f"{out}/{name}", order)
    return list(reports)


def run_all(spark: SparkSession, work: str, sources: Mapping[str, DataFrame],
            skills: Sequence[Skill] | DataFrame = skilled.DEFAULT_SKILLS,
            exclusions: DataFrame | None = None, overrides: DataFrame | None = None,
            database: str | None = None) -> str:
    """From staged sources to a published warehouse and its reports; returns its run id.

    With a `database` the build is published as a version in the catalog as well."""
    master = master_stage(sources, f"{work}/master")
    target = masters.target_rows(master)
    bridge = skill_stage(target, f"{work}/job_skills", skills, exclusions)
    dimension = skilled.skill_dimension(spark, skills)
    run_id = warehouse.publish(spark, f"{work}/warehouse", target, dimension,
                               bridge.select(*warehouse.BRIDGE_COLUMNS), database)
    report_stage(master, dimension, bridge, f"{work}/reports", overrides)
    return run_id
