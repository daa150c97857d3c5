"""Registered queries: every operator on the benchmark tables, read whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill import bindings as b
from postmill.functions import text, values
from postmill.operators import checks, dedup
from postmill.operators.ranks import ranked
from postmill.operators.shared import settled
from postmill.plans import (associations, classify, gap, master, reports, rule_table, skills,
                            staging, versions, views, warehouse)
from postmill.sources import landing, tables
from postmill.session import REQUIRED_CONF

Query = Callable[[SparkSession, str], DataFrame]


def basket_query(build: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(*b.basket(spark, sf_dir))
    return run


def _load_summary(jobs: DataFrame, dimension: DataFrame, bridge: DataFrame) -> DataFrame:
    sources = reports.jobs_by_source(jobs).select(
        F.lit("source").alias("part"), F.col("source").alias("name"), "job_count")
    top = reports.top_skills(dimension, bridge, 10).select(
        F.lit("skill").alias("part"), F.col("skill_name").alias("name"), "job_count")
    return sources.unionByName(top)


def basket_queries() -> dict[str, Query]:
    k, role = list(b.KNOWN), b.ROLE
    q = basket_query
    return {
        "skill_demand": q(views.skill_demand),
        "role_summary": q(lambda j, s, br: views.role_summary(j)),
        "role_skill_demand": q(views.role_skill_demand),
        "skill_cooccurrence": q(views.skill_cooccurrence),
        "role_skill_cooccurrence": q(views.role_skill_cooccurrence),
        "salary_by_role": q(lambda j, s, br: views.salary_by_role(j)),
        "skill_priority": q(lambda j, s, br: gap.skill_priority(j, s, br, k, role)),
        "profile_coverage": q(lambda j, s, br: gap.profile_coverage(j, br, k, role)),
        "marginal_gain": q(lambda j, s, br: gap.next_skills(j, s, br, k, role)),
        "marginal_gain_scaled": q(lambda j, s, br: gap.marginal_gain(j, s, br, k)),
        "market_kpis": q(reports.market_kpis),
        "role_overview": q(lambda j, s, br: reports.role_overview(j)),
        "role_explorer_topk": q(lambda j, s, br: reports.role_top_skills(j, s, br, 5)),
        "role_explorer_top_pairs": q(lambda j, s, br: reports.role_top_pairs(j, s, br, 5)),
        "frequent_pairs": q(lambda j, s, br: reports.frequent_pairs(j, s, br, 10)),
        "assoc_min_support": q(lambda j, s, br: reports.strong_associations(j, s, br, 20, 10)),
        "comparable_salaries": q(lambda j, s, br: reports.comparable_salaries(j, "F", "BUILDING")),
        "warehouse_summary": q(_load_summary),
    }


def _licensing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every posting where a licence word was found, and what the context rule left."""
    word = [s for s in b.TEXT_SKILLS if s.key == b.TEXT_RULE.skill]
    return skills.suppressed_aliases(b.postings(spark, sf_dir), word, (b.TEXT_RULE,))


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skills.skill_audit(b.postings(spark, sf_dir),
                              skills.skill_dimension(spark, b.TEXT_SKILLS),
                              b.text_bridge(spark, sf_dir))


def _sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skills.skill_audit_sample(
        b.postings(spark, sf_dir), skills.skill_dimension(spark, b.TEXT_SKILLS),
        b.text_bridge(spark, sf_dir), risky=("that_word", "license_word", "mail"))


def _excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence of every relation of the bridge."""
    found = b.postings(spark, sf_dir).select(views.KEY, *skills.SEARCH_FIELDS).join(
        b.text_bridge(spark, sf_dir), views.KEY)
    return skills.with_excerpt(found).select(views.KEY, "skill_key", "evidence_excerpt")


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = classify.classify_roles(b.postings(spark, sf_dir).drop("role_family"), None,
                                     b.TEXT_RULES)
    return classify.labelled_predictions(b.text_overrides(spark, sf_dir), staged)


def _fingerprinted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings whose fingerprint covers language and the whole text."""
    posts = b.postings(spark, sf_dir).withColumn("job_fingerprint", text.fingerprint(
        F.col("tags"), F.col("description_text"), F.col("location_raw")))
    return posts.drop("description_text", "tags")


def _word_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of words that a tenth of all documents hold both, words as skills."""
    jobs, words, bridge = b.word_bridge(spark, sf_dir)
    least = max(2, jobs.count() // 10)
    return associations.associations(jobs, words, bridge, least).drop(
        "skill_1_name", "skill_2_name")


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of a document are numbers, the least and the greatest of them."""
    found = F.filter(F.transform(F.split("text", " "), values.to_number), lambda n: n.isNotNull())
    return b.table(spark, sf_dir, "documents").select("doc_id", found.alias("n")).select(
        "doc_id", F.size("n").alias("numbers"), F.array_min("n").alias("least"),
        F.array_max("n").alias("greatest"))


def _default_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 54 skills and the education rule over every document, with sentences added in
    turn that name skills."""
    return skills.extract_skills(b.skilled_postings(spark, sf_dir))


def text_queries() -> dict[str, Query]:
    return {
        "ranked_reviews": lambda s, d: ranked(
            classify.review_queue(b.text_classified(s, d)), classify.review_order()),
        "ranked_audit": lambda s, d: ranked(_audited(s, d), skills.audit_order()),
        "default_skills": _default_skills,
        "word_associations": _word_pairs,
        "classify_by_table": lambda s, d: rule_table.classify_by_table(
            b.postings(s, d), b.word_rules(s, d)),
        "classify_titles": lambda s, d: classify.classify_roles(
            b.table(s, d, "orders").select(
                F.lit("orders").alias("source"), F.col("o_orderkey").cast("string")
                .alias("source_job_id"), b.title_of(F.col("o_orderkey")).alias("job_title_raw"))),
        "classify_with_overrides": lambda s, d: b.text_classified(s, d).select(
            "source", "source_job_id", "automated_role_family", "role_family",
            "classification_method", "role_override_applied", "override_decision",
            "is_target_data_role"),
        "changed_predictions": lambda s, d: classify.changed_predictions(b.text_classified(s, d)),
        "review_queue": lambda s, d: classify.review_queue(b.text_classified(s, d)),
        "prepare_overrides": lambda s, d: classify.prepare_overrides(b.text_reviews(s, d)),
        "classifier_metrics": lambda s, d: classify.classifier_metrics(_evaluated(s, d)),
        "classifier_mismatches": lambda s, d: classify.classifier_mismatches(_evaluated(s, d)),
        "extract_skills": b.text_bridge,
        "extract_skills_joined": b.text_bridge_joined,
        "context_suppression": _licensing,
        "skill_exclusions": lambda s, d: skills.apply_exclusions(
            b.text_bridge(s, d), b.text_exclusions(s, d)).select(views.KEY, "skill_key"),
        "excluded_count": lambda s, d: skills.excluded_count(
            b.text_bridge(s, d), b.text_exclusions(s, d)),
        "skill_audit": _audited,
        "extraction_summary": lambda s, d: skills.extraction_summary(
            b.postings(s, d), b.text_bridge(s, d)),
        "skill_audit_sample": _sample,
        "skill_excerpts": _excerpts,
        "fingerprint_duplicates": lambda s, d: master.duplicate_candidates(
            _fingerprinted(s, d)).drop("job_title_raw"),
        "duplicate_groups": lambda s, d: master.duplicate_groups(_fingerprinted(s, d)),
        "html_to_text": lambda s, d: b.table(s, d, "pages").select(
            "page_id", text.html_to_text(F.col("html")).alias("body")),
        "html_cases": lambda s, d: b.table(s, d, "pages").select("page_id", text.html_to_text(
            F.concat(b.dealt(b.HTML_CASES, "page_id"), F.lit(" | "), "html")).alias("body")),
        "number_parse": _numbers,
        "date_cases": lambda s, d: b.written_dates(s, d).select(
            "o_orderkey", values.parse_instant(F.col("written")).cast("timestamp_ntz").alias("at"),
            values.parse_instant(F.col("case")).cast("timestamp_ntz").alias("case_at")),
    }


def _latest_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = b.paged_records(spark, sf_dir)
    newest = records.agg(F.max("_source_file").alias("n")).scalar()
    return records.filter(F.col("_source_file") == newest).select("guid", "_source_query",
                                                                  "_position")


def record_queries() -> dict[str, Query]:
    def ids(s, d):
        return b.paged_records(s, d).select(text.strip(F.col("guid")).alias("source_job_id"),
                                            "_source_query", "_source_page", "_source_file",
                                            "_position")

    arrival = ["_source_file", "_position"]
    return {
        "latest_batch": _latest_batch,
        "dedup_first": lambda s, d: dedup.keep_first(ids(s, d), ["source_job_id"], arrival),
        "dedup_last": lambda s, d: dedup.keep_last(ids(s, d), ["source_job_id"], arrival),
        "repeat_count": lambda s, d: dedup.repeat_count(ids(s, d), "source_job_id"),
        "duplicate_members": lambda s, d: dedup.duplicate_members(
            ids(s, d), ["source_job_id", "_source_page"], ["_position"]),
        "query_overlap": lambda s, d: staging.query_overlap(
            b.staged_paged(s, d)),
        "crawl_pages": lambda s, d: staging.crawl_pages(ids(s, d)),
        "crawl_novelty": lambda s, d: staging.crawl_summary(ids(s, d)),
        "crawl_totals": lambda s, d: staging.crawl_totals(ids(s, d)),
        "json_fields": lambda s, d: b.table(s, d, "events").select(
            "event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k")),
        "stage_paged": b.staged_paged,
        "stage_snapshot": b.staged_snapshot,
        "staging_report": lambda s, d: staging.staging_report(
            b.paged_records(s, d), b.staged_paged(s, d)),
        "file_provenance": lambda s, d: landing.with_arrival(b.table(s, d, "orders")).select(
            "o_orderkey", "_source_file", "_position"),
        "keep_first_arrival": lambda s, d: dedup.keep_first(
            landing.with_arrival(b.table(s, d, "orders").select("o_custkey", "o_orderkey")),
            ["o_custkey"], landing.ARRIVAL).select("o_custkey", "o_orderkey", "_position"),
        "ranked_master": lambda s, d: ranked(b.conformed(s, d), master.master_order()).select(
            "source_record_key", "publication_date", "row_rank"),
        "conform_union": b.conformed,
        "target_rows": lambda s, d: master.target_rows(b.conformed(s, d)).select(
            "source_record_key", "role_family", "job_fingerprint"),
        "source_reconciliation": lambda s, d: master.source_reconciliation(b.conformed(s, d)),
        "master_duplicates": lambda s, d: master.duplicate_candidates(
            settled(b.conformed(s, d), "master")),
        "bool_parse": lambda s, d: b.table(s, d, "events").select(
            F.col("event_id").alias("_position"),
            values.loose_bool(F.get_json_object("props", "$.k")).alias("flag")),
        "date_parse": lambda s, d: b.paged_records(s, d).select(
            "_position", values.parse_instant(F.col("pubDate")).alias("published"),
            values.parse_instant(F.col("pubDate"), "ms").alias("published_ms"),
            values.parse_instant(F.col("expiryDate")).alias("expires")),
        "salary_text": lambda s, d: b.table(s, d, "orders").select("o_orderkey", values.salary_text(
            F.when(F.col("o_orderkey") % 3 != 0, F.floor(F.col("o_totalprice")).cast("double")),
            F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice") * 4),
            F.when(F.col("o_orderkey") % 5 != 0, F.lit(" usd ")).otherwise(""),
            F.when(F.col("o_orderkey") % 7 != 0, F.lit("Annual"))).alias("salary")),
    }


def _bridge_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated keys of the bridge (none), and of a pair of columns that is no key."""
    # Each of the two checks reads it twice.
    bridge = settled(b.text_bridge(spark, sf_dir).select(views.KEY, "skill_key", "evidence_source"), "bridge")
    other = checks.duplicate_keys(bridge, ["skill_key", "evidence_source"])
    return checks.duplicate_keys(bridge, [views.KEY, "skill_key"]).unionByName(
        other.select(F.col("evidence_source").alias(views.KEY), "skill_key", "key_rows"))


def _warehouse_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The conformed target postings and their title words, converted for loading."""
    jobs = settled(master.target_rows(b.conformed(spark, sf_dir)), "target")
    bridge = skills.extract_skills(jobs, b.TITLE_SKILLS)
    return {"sources": warehouse.source_dimension(jobs),
            "jobs": warehouse.warehouse_jobs(jobs),
            "skills": warehouse.warehouse_skills(skills.skill_dimension(spark, b.TITLE_SKILLS)),
            "job_skills": warehouse.warehouse_bridge(bridge)}


def _warehouse_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row rules of the jobs table on all postings, targets or not."""
    jobs = warehouse.warehouse_jobs(b.conformed(spark, sf_dir))
    return checks.rule_failures(jobs, warehouse.table_rules()["jobs"])


def warehouse_queries() -> dict[str, Query]:
    return {
        "warehouse_counts": lambda s, d: checks.table_counts(_warehouse_tables(s, d)),
        "warehouse_jobs": lambda s, d: _warehouse_tables(s, d)["jobs"].select(
            "source_record_key", "salary_raw", "location_raw", "salary_currency", "tags",
            "is_worldwide", "is_target_data_role", "salary_min", "publication_date"),
        "warehouse_bridge": lambda s, d: _warehouse_tables(s, d)["job_skills"],
        "warehouse_rules": _warehouse_rules,
        "latest_run": lambda s, d: warehouse.latest_of(b.order_runs(s, d)),
        "run_mismatch": lambda s, d: warehouse.row_mismatch(
            warehouse.latest_of(b.order_runs(s, d)), b.loaded_tables(s, d)),
        "missing_views": lambda s, d: checks.missing_names(
            *b.view_names(s, d), "view_name"),
        "expired_versions": lambda s, d: versions.expired(b.order_versions(s, d), 100),
        "strict_flags": lambda s, d: b.table(s, d, "labels").select("doc_id", values.strict_bool(
            F.col("toxic").cast("string")).alias("toxic"), values.strict_bool(F.when(
                F.col("quality") == 1, " Y ").otherwise("no")).alias("good")),
        "stamp_parse": lambda s, d: b.table(s, d, "events").select("event_id", values.iso_z(
            values.parse_stamp(landing.file_stamp(F.concat(F.lit("feed_"), F.replace(
                "event_type", F.lit(" "), F.lit("_")), F.date_format("ts", "'_'yyyyMMdd'_'HHmmss"),
                F.lit(".json"))))).alias("collected_at")),
        "review_problems": lambda s, d: classify.review_problems(b.faulty_reviews(s, d)),
        "dictionary_problems": lambda s, d: tables.dictionary_problems(b.part_dictionary(s, d)),
    }


def _not_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the master has beyond its target rows; it is staged once."""
    table = settled(b.conformed(spark, sf_dir).select("source_record_key", "is_target_data_role"),
                    "master")
    return checks.set_difference(table.select("source_record_key"),
                                 master.target_rows(table).select("source_record_key"))


def quality_queries() -> dict[str, Query]:
    t = b.table
    return {
        "dq_unique": lambda s, d: checks.duplicate_keys(
            t(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]),
        "dq_unique_nocase": lambda s, d: checks.duplicate_keys(
            t(s, d, "part"), ["p_name"], ignore_case=True),
        "dq_foreign_key": lambda s, d: checks.orphans(
            t(s, d, "lineitem"), t(s, d, "customer"), "l_partkey", "c_custkey"),
        "dq_domain": lambda s, d: checks.outside_domain(
            t(s, d, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"]),
        "dq_range": lambda s, d: checks.inverted_range(
            t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", "l_discount"),
            "l_tax", "l_discount"),
        "dq_completeness": lambda s, d: checks.completeness(
            b.conformed(s, d), ["job_title_raw", "company_name", "salary_raw", "expiry_date",
                                "search_queries", "salary_min"]),
        "dq_reconcile": lambda s, d: checks.count_mismatch(
            checks.table_counts({"orders": t(s, d, "orders"), "lines": t(s, d, "lineitem")}),
            checks.table_counts({"orders": b.basket_jobs(s, d), "lines": t(s, d, "orders")})),
        "dq_rules": lambda s, d: checks.rule_failures(t(s, d, "lineitem"), {
            "quantity_below_50": F.col("l_quantity") < 50,
            "known_flag": F.col("l_returnflag").isin("A", "N", "R"),
            "discount_range": F.col("l_discount").between(0.01, 0.09)}),
        "dq_blank": lambda s, d: checks.blank_values(
            b.conformed(s, d), ["salary_raw", "location_raw"]).select("source_record_key"),
        "dq_key_format": lambda s, d: checks.malformed_keys(b.postings(s, d).withColumn(
            "source_record_key", F.when(F.col("source") == "src3", "x::1")
            .otherwise(F.col("source_record_key")))).select("source", "source_job_id"),
        "dq_flag": lambda s, d: checks.flag_mismatch(
            b.text_classified(s, d), "is_target_data_role",
            F.col("automated_role_family") != "Non-target Role").select("source_job_id"),
        "dq_source": lambda s, d: checks.wrong_source(b.postings(s, d), "src1"),
        "dq_target_only": lambda s, d: checks.not_true(
            b.conformed(s, d), "is_target_data_role").select("source_record_key"),
        "dq_set_difference": _not_target,
        "dq_dimension": lambda s, d: checks.dimension_mismatch(
            t(s, d, "customer"), "c_custkey", t(s, d, "events"), "user_id"),
        "dq_unmatched": lambda s, d: checks.unmatched(
            t(s, d, "documents").select("doc_id", "source"),
            t(s, d, "labels").select("doc_id"), ["doc_id"]),
        "dq_bridge_keys": _bridge_keys,
        "value_counts": lambda s, d: reports.value_counts(b.conformed(s, d), "role_family"),
    }


def _in_utc(query: Query) -> Query:
    """Dates are read and written in UTC, whatever the session started with.

    A DataFrame takes its settings from the session when it runs, so they are set here and
    stay; a session that already has them is left alone."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for key, value in REQUIRED_CONF.items():
            if spark.conf.get(key) != value:
                spark.conf.set(key, value)
        return query(spark, sf_dir)
    return run


def all_queries() -> dict[str, Query]:
    found = {**basket_queries(), **text_queries(), **record_queries(), **warehouse_queries(),
             **quality_queries()}
    return {name: _in_utc(query) for name, query in found.items()}
