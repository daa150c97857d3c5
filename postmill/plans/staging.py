"""From raw records to one cleaned row per posting, for both kinds of source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.fixed import (PAGED_COLUMNS, PAGED_LIST_FIELDS, PAGED_REQUIRED_FIELDS,
                            PAGED_TEXT_FIELDS, SNAPSHOT_COLUMNS, SNAPSHOT_LIST_FIELDS,
                            SNAPSHOT_TEXT_FIELDS)
from postmill.functions.text import (casefold_sort, fingerprint, html_to_text, is_blank,
                                     location_list, pipe_list, squash, strip)
from postmill.functions.values import parse_instant, parse_iso, salary_text, to_number
from postmill.operators import checks
from postmill.operators.dedup import keep_first_collecting, keep_last
from postmill.operators.skew import SLICES, join_group_facts
from postmill.plans.classify import classify_roles

PAGED_REQUIRED = (*PAGED_REQUIRED_FIELDS, "_source_query", "_collected_at")
PAGED_OPTIONAL = ({c: "string" for c in PAGED_TEXT_FIELDS if c not in PAGED_REQUIRED}
                  | {c: "array<string>" for c in PAGED_LIST_FIELDS})
SNAPSHOT_REQUIRED = (*SNAPSHOT_TEXT_FIELDS, *SNAPSHOT_LIST_FIELDS)
ARRIVAL = ("_source_file", "_position")


def records_without_id(records: DataFrame, id_column: str) -> DataFrame:
    return records.filter(is_blank(F.col(id_column)))


def stage_paged(records: DataFrame, source: str, overrides: DataFrame | None = None,
                epoch_unit: str = "s", arrival=ARRIVAL) -> DataFrame:
    """Stage records of a paged, multi-query source.

    The first arrival of a posting is kept, together with every query that
    found it. That step comes first, so that cleaning, HTML removal and
    classification run on surviving records only.
    """
    checks.require_columns(records, PAGED_REQUIRED, "paged records")
    raw = checks.with_optional(records, PAGED_OPTIONAL).withColumn("source_job_id",
                                                                   strip(F.col("guid")))
    used = ["source_job_id", *PAGED_REQUIRED[1:], *PAGED_OPTIONAL, *arrival]
    first = keep_first_collecting(raw.select(*dict.fromkeys(used)), ["source_job_id"],
                                  arrival, "_source_query", "_queries")
    low, high = to_number(F.col("minSalary")), to_number(F.col("maxSalary"))
    locations = F.col("locationRestrictions")
    clean = first.select(
        F.lit(source).alias("source"), "source_job_id",
        squash(F.col("title")).alias("job_title_raw"),
        squash(F.col("companyName")).alias("company_name"),
        squash(F.col("companyLogo")).alias("company_logo_url"),
        pipe_list(F.col("parentCategories")).alias("category"),
        pipe_list(F.col("categories")).alias("tags"),
        F.lower(squash(F.col("employmentType"))).alias("job_type"),
        pipe_list(F.col("seniority")).alias("seniority_raw"),
        parse_instant(F.col("pubDate"), epoch_unit).alias("publication_date"),
        parse_instant(F.col("expiryDate"), epoch_unit).alias("expiry_date"),
        location_list(locations).alias("location_raw"),
        pipe_list(F.col("timezoneRestrictions")).alias("timezone_raw"),
        F.coalesce(F.size(locations) == 0, F.lit(False)).alias("is_worldwide"),
        low.alias("salary_min"), high.alias("salary_max"),
        F.upper(squash(F.col("currency"))).alias("salary_currency"),
        F.lower(squash(F.col("salaryPeriod"))).alias("salary_period"),
        html_to_text(F.col("description")).alias("description_text"),
        squash(F.col("applicationLink")).alias("job_url"),
        query_list("_queries").alias("search_queries"),
        F.col("_collected_at").alias("collected_at"))
    priced = clean.withColumn("salary_raw", salary_text(
        F.col("salary_min"), F.col("salary_max"), F.col("salary_currency"),
        F.col("salary_period")))
    return _finish(priced, overrides, PAGED_COLUMNS)


def stage_snapshot(records: DataFrame, source: str, overrides: DataFrame | None = None,
                   arrival=ARRIVAL) -> DataFrame:
    """Stage records of a source that delivers everything in one snapshot.

    The last arrival of a posting is kept; salaries are free text; tags sort by
    code point.
    """
    checks.require_columns(records, SNAPSHOT_REQUIRED, "snapshot records")
    raw = records.withColumn("source_job_id", F.col("id").cast("string"))
    last = keep_last(raw, ["source_job_id"], arrival)
    clean = last.select(
        F.lit(source).alias("source"), "source_job_id",
        squash(F.col("title")).alias("job_title_raw"),
        squash(F.col("company_name")).alias("company_name"),
        F.col("company_logo").alias("company_logo_url"),
        squash(F.col("category")).alias("category"),
        pipe_list(F.col("tags"), ignore_case=False).alias("tags"),
        F.lower(squash(F.col("job_type"))).alias("job_type"),
        parse_iso(F.col("publication_date")).alias("publication_date"),
        squash(F.col("candidate_required_location")).alias("location_raw"),
        squash(F.col("salary")).alias("salary_raw"),
        html_to_text(F.col("description")).alias("description_text"),
        F.col("url").alias("job_url"),
        F.col("_collected_at").alias("collected_at"))
    return _finish(clean, overrides, SNAPSHOT_COLUMNS)


def query_list(queries: str):
    cleaned = F.transform(queries, squash)
    return F.array_join(casefold_sort(F.array_distinct(F.filter(cleaned, lambda q: q != ""))), "|")


def _finish(clean: DataFrame, overrides: DataFrame | None, columns) -> DataFrame:
    marked = clean.withColumn("job_fingerprint", fingerprint(
        F.col("company_name"), F.col("job_title_raw"), F.col("location_raw")))
    return classify_roles(marked, overrides).select(*columns)


def newest_first() -> list:
    return [F.col("publication_date").desc_nulls_last(), F.col("source_job_id")]


def query_overlap(staged: DataFrame) -> DataFrame:
    """Postings found by more than one search."""
    return (staged.filter(F.col("search_queries").contains("|"))
            .select("job_title_raw", "company_name", "search_queries"))


def staging_report(records: DataFrame, staged: DataFrame) -> DataFrame:
    """Counts that describe one staging run, in one row."""
    received = records.agg(F.count("*").alias("n")).scalar()
    fingerprint = F.col("job_fingerprint")
    repeated = F.count("*") - F.count_distinct(fingerprint) - F.when(
        F.count_if(fingerprint.isNull()) > 0, 1).otherwise(0)
    priced = F.col("salary_raw") != ""
    report = staged.agg(
        F.count("*").alias("unique_jobs"),
        repeated.alias("duplicate_fingerprints"),
        F.count_if("is_target_data_role").alias("target_jobs"),
        F.count_if("role_override_applied").alias("overrides_applied"),
        F.count_if(F.col("automated_role_family") != F.col("role_family"))
        .alias("changed_predictions"),
        F.count_if(~priced).alias("missing_salary"),
        F.count_if(F.col("job_title_raw") == "").alias("missing_titles"),
        F.count_if(F.col("company_name") == "").alias("missing_companies"),
        F.count_if(F.col("publication_date").isNull()).alias("missing_publication_dates"))
    return report.select(
        received.alias("records_received"), "unique_jobs",
        (received - F.col("unique_jobs")).alias("repeated_records"), "target_jobs",
        "overrides_applied", "changed_predictions", "duplicate_fingerprints",
        "missing_salary", "missing_titles", "missing_companies", "missing_publication_dates")


def crawl_pages(records: DataFrame, query: str = "_source_query", page: str = "_source_page",
                item: str = "source_job_id") -> DataFrame:
    """Per query and page: records, new ids, and whether the crawl still counts it.

    An id is new on the first page of the query that shows it. A crawl ends at
    the first page that is missing or brings nothing new; later pages do not
    count. Everything is reduced per (query, page) or (query, id) before the
    one small window over pages.
    """
    sizes = records.groupBy(query, page).agg(F.count("*").alias("page_records"))
    first = (records.filter(F.col(item).isNotNull()).groupBy(query, item)
             .agg(F.min(page).alias(page)))
    fresh = first.groupBy(query, page).agg(F.count("*").alias("new_ids"))
    pages = sizes.join(fresh, [query, page], "left").withColumn(
        "new_ids", F.coalesce("new_ids", F.lit(0)))
    in_order = Window.partitionBy(query).orderBy(page)
    going = ((F.row_number().over(in_order) == F.col(page)) & (F.col("new_ids") > 0)).cast("int")
    return (pages.withColumn("_going", going)
            .withColumn("counted", F.min("_going").over(
                in_order.rowsBetween(Window.unboundedPreceding, 0)) == 1)
            .drop("_going"))


def crawl_summary(records: DataFrame, query: str = "_source_query", page: str = "_source_page",
                  item: str = "source_job_id") -> DataFrame:
    """Per query: pages, records, unique ids and repeats among the counted pages."""
    return (crawl_pages(records, query, page, item).filter("counted").groupBy(query)
            .agg(F.count("*").alias("pages_saved"),
                 F.sum("page_records").alias("records_received"),
                 F.sum("new_ids").alias("unique_ids"))
            .withColumn("repeated_records", F.col("records_received") - F.col("unique_ids")))


def crawl_totals(records: DataFrame, query: str = "_source_query", page: str = "_source_page",
                 item: str = "source_job_id", slices: int = SLICES) -> DataFrame:
    """Over all queries: pages, records, ids seen and repeats, in one row.

    The last page that counts reaches the ids of its query in `slices` parts, since one
    query may have found most of them."""
    counted = crawl_pages(records, query, page, item).filter("counted")
    last = counted.groupBy(query).agg(F.max(page).alias("_last"))
    first = (records.filter(F.col(item).isNotNull()).groupBy(query, item)
             .agg(F.min(page).alias("_first")))
    ids = (join_group_facts(first, last, [query], [item], slices).filter("_first <= _last")
           .agg(F.count_distinct(item).alias("n")))
    return (counted.agg(F.count("*").alias("pages_saved"),
                        F.sum("page_records").alias("records_received"))
            .withColumn("unique_ids", ids.scalar())
            .withColumn("repeated_records", F.col("records_received") - F.col("unique_ids")))
