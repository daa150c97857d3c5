"""Skill extraction into an evidence-carrying bridge, and its audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.fixed import (AUDIT_AMBIGUOUS, AUDIT_COLUMNS, AUDIT_MOST, AUDIT_NONE, EXCERPT_FALLBACK, OVERRIDE_ACTIONS, RISKY_SKILLS, SAMPLE_SEED,
                            SAMPLES_PER_SKILL, SEARCH_FIELDS, SKILL_COLUMNS, SKILLS,
                            TOP_COUNT_JOBS)
from postmill.functions.matching import (STUDY_FIELD_RULE, ContextRule, Skill, alias_hits,
                                         anchors_in, candidates, dictionary_column, excerpt,
                                         skills_from_rows)
from postmill.functions.text import casefold_sort, drop_urls, fold, squash, strip
from postmill.operators import checks
from postmill.operators.dedup import top_rows
from postmill.plans.views import KEY
from postmill.session import inline_table

DEFAULT_SKILLS = skills_from_rows(SKILLS)


def skill_dimension(spark: SparkSession,
                    skills: Sequence[Skill] | DataFrame = DEFAULT_SKILLS) -> DataFrame:
    if isinstance(skills, DataFrame):
        return skills.select(*SKILL_COLUMNS)
    return inline_table(spark, SKILL_COLUMNS, [(s.key, s.name, s.category) for s in skills])


def extract_skills(jobs: DataFrame, skills: Sequence[Skill] = DEFAULT_SKILLS,
                   rules: Sequence[ContextRule] = (STUDY_FIELD_RULE,),
                   fields: Sequence[str] = SEARCH_FIELDS) -> DataFrame:
    """One row per job and detected skill, with where and by which alias.

    All fields of a job are in its row, so matching and grouping by skill are
    projections: one scan, no shuffle, and a hot source costs nothing extra.
    Cleaning, folding and matching are separate steps so that each text is
    cleaned once, not once per alias.
    """
    dictionary = dictionary_column(skills)
    heard = _folded(jobs, fields).select(
        "*", *[anchors_in(F.col(f"_{f}"), skills).alias(f"_in_{f}") for f in fields])
    return _group_hits(heard, {f: candidates(dictionary, F.col(f"_in_{f}")) for f in fields},
                       rules, fields)


def suppressed_aliases(jobs: DataFrame, skills: Sequence[Skill], rules: Sequence[ContextRule],
                       fields: Sequence[str] = SEARCH_FIELDS) -> DataFrame:
    """(key, without_rule, with_rule): the aliases found in each job, with and without the
    context rules, for jobs that have any. Both come from one pass over the texts."""
    dictionary = dictionary_column(skills)
    heard = _folded(jobs, fields).select(
        "*", *[anchors_in(F.col(f"_{f}"), skills).alias(f"_in_{f}") for f in fields])

    def named(some: Sequence[ContextRule]) -> Column:
        found = [F.transform(alias_hits(F.col(f"_{f}"), candidates(dictionary, F.col(f"_in_{f}")),
                                        some), lambda h: h["alias"]) for f in fields]
        return F.array_distinct(F.concat(*found))

    heard_any = F.lit(False)
    for f in fields:
        heard_any = heard_any | (F.size(f"_in_{f}") > 0)
    both = heard.filter(heard_any).select(KEY, named(()).alias("all"), named(rules).alias("kept"))
    return both.filter(F.size("all") > 0).select(
        KEY, F.array_join(casefold_sort(F.col("all")), "|").alias("without_rule"),
        F.when(F.size("kept") > 0, F.array_join(casefold_sort(F.col("kept")), "|"))
        .alias("with_rule"))


def _folded(jobs: DataFrame, fields: Sequence[str]) -> DataFrame:
    return jobs.select(KEY, *[fold(drop_urls(F.col(f))).alias(f"_{f}") for f in fields])


def _group_hits(heard: DataFrame, entries: dict[str, Column], rules: Sequence[ContextRule],
                fields: Sequence[str]) -> DataFrame:
    """Bridge rows from folded texts and candidate entries.

    The outer tests look redundant but matter: a column used twice keeps its
    own projection, while one used once would be pulled into the lambda and
    computed again for every dictionary entry.
    """
    def hits_in(field: str) -> Column:
        folded, heard_in = F.col(f"_{field}"), F.col(f"_in_{field}")
        found = F.transform(
            alias_hits(folded, entries[field], rules),
            lambda h: F.struct(h["skill_key"].alias("skill_key"), h["alias"].alias("alias")))
        nothing = (folded == "") | (F.size(heard_in) == 0)
        return F.when(~nothing, found).otherwise(F.array().cast(
            "array<struct<skill_key: string, alias: string>>"))

    hits = heard.select(KEY, *[hits_in(f).alias(f) for f in fields])
    every = F.concat(*fields)
    found = hits.select(KEY, *fields, F.explode(
        F.array_distinct(F.transform(every, lambda h: h["skill_key"]))).alias("skill_key"))

    def of_skill(h):
        return h["skill_key"] == F.col("skill_key")

    where = F.array_compact(F.array(*[F.when(F.exists(f, of_skill), F.lit(f))
                                      for f in sorted(fields)]))
    aliases = F.array_distinct(F.transform(F.filter(every, of_skill), lambda h: h["alias"]))
    return (found.select(KEY, "skill_key", where.alias("where"), aliases.alias("aliases"))
            .select(KEY, "skill_key", F.array_join("where", "|").alias("evidence_source"),
                    F.array_join(casefold_sort(F.col("aliases")), "|").alias("matched_aliases"),
                    F.size("where").alias("evidence_field_count")))


def check_extraction_input(jobs: DataFrame) -> None:
    checks.require_columns(jobs, [KEY, "source", "source_job_id", "job_title_raw", "company_name",
                                  "role_family", "tags", "description_text", "publication_date"],
                           "extraction input")
    checks.one_row_per_key(jobs, [KEY], "extraction input")


def clean_exclusions(overrides: DataFrame) -> DataFrame:
    columns = [KEY, "skill_key", "override_action", "reason"]
    checks.require_columns(overrides, columns, "skill overrides")
    return overrides.select(*[strip(F.col(c)).alias(c) for c in columns])


def check_exclusions(overrides: DataFrame) -> DataFrame:
    checks.assert_empty(checks.outside_domain(overrides, "override_action", OVERRIDE_ACTIONS),
                        "unknown skill override actions")
    return checks.one_row_per_key(overrides, [KEY, "skill_key"], "skill overrides")


def apply_exclusions(bridge: DataFrame, overrides: DataFrame) -> DataFrame:
    """The bridge without the pairs a person rejected."""
    return bridge.join(_excluded(overrides), [KEY, "skill_key"], "left_anti")


def excluded_count(bridge: DataFrame, overrides: DataFrame) -> DataFrame:
    return (bridge.join(_excluded(overrides), [KEY, "skill_key"], "left_semi")
            .agg(F.count("*").alias("removed_relations")))


def _excluded(overrides: DataFrame) -> DataFrame:
    return overrides.filter(F.col("override_action") == "exclude").select(KEY, "skill_key")


def _per_job(skills: DataFrame, bridge: DataFrame) -> DataFrame:
    named = bridge.select(KEY, "skill_key").join(skills.select("skill_key", "skill_name"),
                                                 "skill_key", "left")
    return named.groupBy(KEY).agg(F.count("*").cast("int").alias("detected_skill_count"),
                                  F.collect_set("skill_name").alias("_names"))


def skill_audit(jobs: DataFrame, skills: DataFrame, bridge: DataFrame) -> DataFrame:
    """One row per job, also for jobs without skills: count and sorted names."""
    return _audited(jobs, skills, bridge).select(
        KEY, "source", "source_job_id", "job_title_raw", "company_name", "role_family",
        "publication_date", "detected_skill_count", "detected_skills")


def audit_order() -> list:
    return [F.col("detected_skill_count"), F.col("role_family"), F.col("job_title_raw"),
            F.col(KEY)]


def jobs_without_skills(audit: DataFrame) -> DataFrame:
    return audit.filter(F.col("detected_skill_count") == 0)


def _audited(jobs: DataFrame, skills: DataFrame, bridge: DataFrame) -> DataFrame:
    names = F.array_join(casefold_sort(F.coalesce("_names", F.array().cast("array<string>"))), "|")
    return (jobs.join(_per_job(skills, bridge), KEY, "left")
            .withColumns({"detected_skill_count": F.coalesce("detected_skill_count", F.lit(0)),
                          "detected_skills": names}).drop("_names"))


def extraction_summary(jobs: DataFrame, bridge: DataFrame) -> DataFrame:
    """Relations, covered jobs, coverage and mean skills per job, in one row."""
    per_job = bridge.groupBy(KEY).agg(F.count("*").alias("n"))
    total = jobs.agg(F.count("*").alias("n")).scalar()
    return per_job.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("relations"),
                       F.count("*").alias("jobs_with_skills")).select(
        total.alias("jobs"), "relations", "jobs_with_skills",
        F.round(F.try_divide(F.lit(100.0) * F.col("jobs_with_skills"), total), 2)
        .alias("coverage_pct"),
        F.round(F.try_divide(F.col("relations").cast("double"), total), 2)
        .alias("mean_skills_per_job"))


def _audit_rows(rows: DataFrame, audit_type: str) -> DataFrame:
    described = rows.withColumn("audit_type", F.lit(audit_type))
    blanks = {c: F.lit("") for c in AUDIT_COLUMNS if c not in described.columns}
    return (described.withColumns(blanks)
            .withColumn("detected_skill_count", F.col("detected_skill_count").cast("string"))
            .select(*AUDIT_COLUMNS))


def risky_matches(bridge: DataFrame, risky: Sequence[str] = RISKY_SKILLS,
                  per_skill: int = SAMPLES_PER_SKILL, seed: int = SAMPLE_SEED) -> DataFrame:
    """A repeatable sample of at most `per_skill` relations for each risky skill."""
    draw = F.md5(F.concat_ws("|", F.col(KEY).cast("string"), F.lit(str(seed))).cast("binary"))
    return top_rows(bridge.filter(F.col("skill_key").isin(*risky)), ["skill_key"],
                    [draw, F.col(KEY)], per_skill)


def with_excerpt(rows: DataFrame) -> DataFrame:
    """Add the text around the first matched alias, title before tags before
    description; without a hit, the start of the description."""
    # Folded once here: inside the search for an alias it would be folded for each one.
    text = rows.withColumns({f"_{f}": squash(F.col(f)) for f in SEARCH_FIELDS})
    text = text.withColumns({f"_low_{f}": fold(F.col(f"_{f}")) for f in SEARCH_FIELDS})
    aliases = F.transform(F.split(squash(F.col("matched_aliases")), r"\|"), lambda a: F.trim(a))
    around = [excerpt(F.col(f"_{f}"), F.col(f"_low_{f}"), aliases) for f in SEARCH_FIELDS]
    start = F.substring("_description_text", 1, EXCERPT_FALLBACK)
    return (text.withColumn("evidence_excerpt", F.coalesce(*around, start))
            .drop(*[f"{p}{f}" for f in SEARCH_FIELDS for p in ("_", "_low_")]))


def skill_audit_sample(jobs: DataFrame, skills: DataFrame, bridge: DataFrame,
                       risky: Sequence[str] = RISKY_SKILLS, top: int = TOP_COUNT_JOBS) -> DataFrame:
    """Rows for manual review: risky matches, the jobs with most skills, and
    every job without skills.

    The three parts cannot overlap (the type is part of the identity and each
    part is unique by construction), so no deduplication is needed. Only the
    bounded sample (samples per skill times listed skills) is broadcast.
    """
    columns = [KEY, "source", "source_job_id", "job_title_raw", "company_name", "role_family",
               "tags", "description_text", "job_url"]
    sample = F.broadcast(risky_matches(bridge, risky))
    matched = (jobs.select(*columns).join(sample, KEY)
               .join(skills.select("skill_key", "skill_name"), "skill_key"))
    # Below the joins only the start of a description is left of it.
    short = jobs.select(*[c for c in columns if c not in ("tags", "description_text")], F.substring(
        squash(F.col("description_text")), 1, EXCERPT_FALLBACK).alias("evidence_excerpt"))
    audited = _audited(short, skills, bridge)
    most = audited.orderBy(F.desc("detected_skill_count"), KEY).limit(top)
    none = audited.filter("detected_skill_count = 0")
    return (_audit_rows(with_excerpt(matched), AUDIT_AMBIGUOUS)
            .unionByName(_audit_rows(most, AUDIT_MOST))
            .unionByName(_audit_rows(none, AUDIT_NONE)))
