"""The benchmark tables seen as postings, skills and bridge.

Baskets: an order is a posting, its priority the role, its customer the
company, the brands of its parts the skills. Everything is read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.matching import ContextRule, skills_from_rows
from postmill.plans.classify import classify_roles, clean_overrides, prepare_overrides
from postmill.plans.master import build_master
from postmill.plans.skill_index import extract_skills_joined
from postmill.plans.skills import extract_skills
from postmill.plans.staging import stage_paged, stage_snapshot
from postmill.plans.views import KEY
from postmill.session import inline_table

KNOWN = ("brand_1", "brand_2", "brand_3", "brand_4")
ROLE = "1-URGENT"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def skill_key(brand: Column) -> Column:
    return F.lower(F.replace(brand, F.lit("#"), F.lit("_")))


def basket_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    kind = F.col("o_orderkey") % 4
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias(KEY),
        F.concat(F.lit("status "), "o_orderstatus").alias("source"),
        F.col("o_orderpriority").alias("role_family"),
        F.col("o_custkey").alias("company_name"),
        F.when(kind.isin(1, 3), F.col("o_totalprice") * 0.75).alias("salary_min"),
        F.when(kind.isin(2, 3), F.col("o_totalprice")).alias("salary_max"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("salary_currency"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("c_mktsegment")).alias("salary_period"))


def basket_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.regexp_extract("p_brand", r"([0-9]+)", 1).cast("int")
    return (table(spark, sf_dir, "part").select("p_brand").distinct()
            .select(skill_key(F.col("p_brand")).alias("skill_key"),
                    F.col("p_brand").alias("skill_name"),
                    F.concat(F.lit("group "), (number % 5).cast("string")).alias("skill_category")))


def basket_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with the set of its brands' skill keys."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", skill_key(F.col("p_brand")).alias("k"))
    return (lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
            .groupBy(F.col("l_orderkey").alias(KEY)).agg(F.collect_set("k").alias("skills")))


def basket(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (basket_jobs(spark, sf_dir), basket_skills(spark, sf_dir),
            basket_sets(spark, sf_dir))


# --- text: a document is a posting, its first line the title ------------------
# A dictionary of words that occur in the documents, with
# overlapping aliases, punctuation and non-ASCII letters.
TEXT_SKILL_ROWS = (
    ("open_license", "Open license", "Legal", "MIT License|Apache License|General Public License|GNU General Public License"),
    ("license_word", "License", "Legal", "license|licensed|License, Version"),
    ("that_word", "That", "English", "that|that the"),
    ("with_word", "With", "English", "with|with the|with and"),
    ("this_word", "This", "English", "this|this is|this work"),
    ("from_word", "From", "English", "from|from the"),
    ("then_word", "Then", "Invented", "then|thea|thanea"),
    ("attion_word", "attion", "Invented", "attion|The and attion|thanedble"),
    ("mail", "Mail address", "Contact", "mail5.example.com|example.com"),
    ("para_word", "Para", "Spanish", "para|para los"),
    ("nicht_word", "Nicht", "German", "Nicht|sch|für"),
    ("dans_word", "Dans", "French", "dans|de la|été"),
)
TEXT_SKILLS = skills_from_rows(TEXT_SKILL_ROWS)
# 'license' near an Apache or GNU notice does not count unless something is released.
TEXT_RULE = ContextRule("license_word", ("apache license", "gnu general"), ("released under",))
# Ordered title rules in the words of the documents.
TEXT_RULES = (
    ("Data Analyst", r"\bthe\s+and\b|\bthat\b.*\bthe\b"),
    ("Data Engineer", r"\b(?:in|of)\s+the\b"),
    ("BI Analyst", r"\bwith\b|\bfrom\b"),
    ("Business Analyst", r"\bthis\b|\bis\b"),
    ("Other Analytics", r"\bthe?\b"),
)


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("::"), F.col("doc_id").cast("string")).alias(KEY),
        "source", F.col("doc_id").cast("string").alias("source_job_id"),
        F.get(F.split(text, "\n", 2), 0).alias("job_title_raw"), F.col("lang").alias("tags"),
        text.alias("description_text"), F.col("source").alias("company_name"),
        F.col("lang").alias("role_family"), F.col("lang").alias("location_raw"),
        F.timestamp_seconds(1704067200 + F.col("doc_id") * 60).alias("publication_date"),
        F.concat(F.lit("https://example.com/"), F.col("doc_id").cast("string")).alias("job_url"),
        F.concat(F.lit("query "), "lang").alias("search_queries"))


def text_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_skills(postings(spark, sf_dir), TEXT_SKILLS, (TEXT_RULE,))


def text_bridge_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    dictionary = inline_table(spark, ("skill_key", "skill_name", "skill_category", "aliases"),
                              TEXT_SKILL_ROWS)
    return extract_skills_joined(postings(spark, sf_dir), dictionary, (TEXT_RULE,))


def text_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as a filled-in review table, with the slips reviewers make."""
    quality, toxic, doc = F.col("quality"), F.col("toxic"), F.col("doc_id")
    decision = (F.when(doc % 9 == 0, "Expired link").when(doc % 9 == 1, "Unverified")
                .when((quality == 1) & (toxic == 0), " Correct ")
                .when(quality == 0, "False Positive").otherwise("Incorrect Role Family"))
    family = (F.when(quality == 0, "Non-target Role").when(toxic == 1, "Analytics engineer")
              .when(doc % 2 == 0, "Data Analyst ").otherwise("Data Engineer"))
    return table(spark, sf_dir, "labels").select(
        doc.cast("string").alias("source_job_id"),
        F.concat(F.lit("Document "), doc.cast("string")).alias("job_title_raw"),
        decision.alias("manual_decision"), family.alias("correct_role_family"),
        F.when(toxic == 1, "see notes").alias("review_notes"))


def faulty_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reviews with some unknown decisions, unknown families and blanks."""
    doc = F.col("source_job_id").cast("long")
    return text_reviews(spark, sf_dir).withColumns({
        "manual_decision": F.when(doc % 11 == 0, "Sure").otherwise(F.col("manual_decision")),
        "correct_role_family": F.when(doc % 13 == 0, "Cook").when(doc % 17 == 0, " ")
        .otherwise(F.col("correct_role_family"))})


def text_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified reviews with the source of their document."""
    verified = prepare_overrides(text_reviews(spark, sf_dir))
    sources = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("source_job_id"), "source")
    return clean_overrides(verified.join(sources, "source_job_id"), "src0")


def text_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_roles(postings(spark, sf_dir).drop("role_family"),
                          text_overrides(spark, sf_dir), TEXT_RULES)


def text_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic-labelled documents: their 'that' matches are rejected by hand."""
    sources = table(spark, sf_dir, "documents").select("doc_id", "source")
    return (table(spark, sf_dir, "labels").filter("toxic = 1").join(sources, "doc_id")
            .select(F.concat("source", F.lit("::"), F.col("doc_id").cast("string")).alias(KEY),
                    F.lit("that_word").alias("skill_key"), F.lit("exclude").alias("override_action"),
                    F.lit("by label").alias("reason")))


def word_bridge(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents as jobs and the words of their texts as skills."""
    words = F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z]{3,}"), 0))
    bridge = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias(KEY), F.explode(words).alias("skill_key"))
    names = bridge.select("skill_key").distinct().withColumn("skill_name", F.col("skill_key"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias(KEY)), names, bridge


def word_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title rule for every word of the benchmark items: some hundreds to thousands. The
    smaller its md5, the earlier a word's rule."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(
        F.lower("text"), F.lit("[a-z]{3,}"), 0)).alias("w")).distinct()
    return words.select(
        F.md5("w").alias("rule_no"), F.concat(F.lit("Family "), F.length("w").cast("string"))
        .alias("family"), F.concat(F.lit("(^|[^a-z0-9])"), "w", F.lit("([^a-z0-9]|$)"))
        .alias("pattern"), F.array("w").alias("words"))


# Sentences with skills of the default dictionary, in and out of contexts.
SKILL_SENTENCES = (
    "We use SQL and Python daily, see https://example.com/docs/api/python/ for more.",
    "Bachelor's degree in Data Science, Statistics, Mathematics or a related field.",
    "Perform statistical analysis and hypothesis testing for A/B testing programmes.",
    "Build and maintain REST APIs; dashboards in Power BI and Tableau.",
    "Experimentation initiatives and nothing else.",
    "A degree in statistics. You apply statistics to forecasting in Excel, C++ or Rust.",
    "Machine learning with dbt, Airflow and Snowflake; ETL pipelines.",
)


def skilled_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings whose text is the document and one of the sentences."""
    number = F.col("source_job_id").cast("long")
    sentence = F.element_at(F.array(*[F.lit(s) for s in SKILL_SENTENCES]),
                            (number % len(SKILL_SENTENCES) + 1).cast("int"))
    return postings(spark, sf_dir).withColumn("description_text", F.concat(
        "description_text", F.lit(" "), sentence))


# --- raw records: events arrive in pages, orders in one snapshot --------------
# Titles given to the rows in turn.
TITLES = ("Senior Data Analyst", "Lead  Data Engineer", "Senior Data Scientist",
          "Analytics Engineer", "Power BI Developer", "Business Intelligence Analyst",
          "Business Analyst", "Analytics Director", "Backend Software Engineer",
          "ML Engineer", "Clin Bus Intellig Analyst-Sr", "Decision Scientist",
          "Reporting Analyst", "Product Analyst", "Marketing Analyst II", "Operation Analyst",
          "Insight Analyst", "Director, Growth Analytics", "Web Analytics Lead",
          "Insights Manager", "Engineer, Business Intelligence", "Tableau Expert",
          "Data Platform Engineer", "Head of\nAnalytics")


# What titles, tags and descriptions of those records are searched for.
TITLE_SKILL_ROWS = (
    ("data", "Data", "Field", "data"), ("analyst", "Analyst", "Role", "analyst|data analyst"),
    ("engineer", "Engineer", "Role", "engineer|ML Engineer"),
    ("alpha", "Alpha", "Tag", "alpha"), ("order", "Order", "Record", "order|value"),
)
TITLE_SKILLS = skills_from_rows(TITLE_SKILL_ROWS)


def title_of(number: Column) -> Column:
    titles = F.array(*[F.lit(t) for t in TITLES])
    return F.element_at(titles, (number % len(TITLES) + 1).cast("int"))


def paged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as landed records: type = query, day = page, user = posting."""
    user, event, value = F.col("user_id"), F.col("event_id"), F.col("value")
    day = F.dayofmonth("ts")
    digit = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit(" job-"), user.cast("string")).alias("guid"),
        title_of(user).alias("title"),
        F.concat(F.lit("Company  "), (user % 40).cast("string")).alias("companyName"),
        F.concat(F.lit("<p>Value <b>"), F.round(value, 2).cast("string"),
                 F.lit("</b> &amp; more</p><!-- x --><script>drop()</script>")).alias("description"),
        F.when(event % 2 == 0, F.unix_timestamp("ts").cast("string"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("pubDate"),
        F.when(event % 5 == 0, "not a date").alias("expiryDate"),
        F.concat(F.lit("https://jobs.example.com/"), user.cast("string")).alias("applicationLink"),
        F.when(digit % 3 > 0, (digit * 1000).cast("string")).alias("minSalary"),
        F.when(digit % 3 > 1, (digit * 1500 + 0.5).cast("string")).alias("maxSalary"),
        F.when(digit % 4 > 0, "usd").alias("currency"),
        F.when(digit % 5 > 0, "Annual").alias("salaryPeriod"),
        F.when(user % 3 == 0, F.array().cast("array<string>"))
        .when(user % 3 == 1, F.array(F.lit("Spain "), F.lit('{"name": "Canada"}'), F.lit("Spain")))
        .alias("locationRestrictions"),
        F.array(F.lit("sql"), F.lit("Beta"), F.lit("alpha "), F.lit(""),
                F.col("event_type")).alias("categories"),
        F.replace("event_type", F.lit("_"), F.lit(" ")).alias("_source_query"),
        F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("_collected_at"),
        day.alias("_source_page"), F.date_format("ts", "yyyyMMdd").alias("_source_file"),
        event.alias("_position"))


def snapshot_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as one snapshot: customer = posting, later orders replace earlier."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        customer.alias("id"), F.concat(F.lit("https://example.org/"), customer.cast("string"))
        .alias("url"),
        title_of(customer).alias("title"),
        F.concat(F.lit("Company "), (customer % 40).cast("string")).alias("company_name"),
        F.lit("https://example.org/logo").alias("company_logo"),
        F.col("o_orderpriority").alias("category"),
        F.array(F.lit("b"), F.lit("B"), F.lit(" a "), F.col("o_orderstatus")).alias("tags"),
        F.lit("Full_Time").alias("job_type"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("publication_date"),
        F.when(customer % 2 == 0, "Canada|Spain").otherwise("Worldwide")
        .alias("candidate_required_location"),
        F.when(F.col("o_orderstatus") == "F", "").otherwise("40k - 50k").alias("salary"),
        F.concat(F.lit("<div>Order&nbsp;"), key.cast("string"), F.lit("</div>"))
        .alias("description"),
        F.lit("2024-02-01T00:00:00Z").alias("_collected_at"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("_source_file"), key.alias("_position"))


def _corrected(ids: DataFrame, number: str, source: str, prefix: str) -> DataFrame:
    """Reviews of some postings of a staged source: right for even numbers, off-target else."""
    n = F.col(number)
    return ids.select(
        F.lit(source).alias("source"), F.concat(F.lit(prefix), n.cast("string")).alias("source_job_id"),
        F.when(n % 2 == 0, "Data Analyst").otherwise("Non-target Role").alias("correct_role_family"),
        F.lit("Incorrect Role Family").alias("manual_decision"))


def staged_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").distinct().filter("user_id % 25 = 3")
    return stage_paged(paged_records(spark, sf_dir), "Paged",
                       _corrected(users, "user_id", "Paged", "job-"))


def staged_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").filter("c_custkey % 40 = 7")
    return stage_snapshot(snapshot_records(spark, sf_dir), "Snapshot",
                          _corrected(customers, "c_custkey", "Snapshot", ""))


def conformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both staged sources in one master table, newest-first order left to the sink."""
    return build_master({"Paged": staged_paged(spark, sf_dir),
                         "Snapshot": staged_snapshot(spark, sf_dir)}, verify=False)


def order_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as load runs; what they claim to have loaded is mostly wrong."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.cast("string").alias("run_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("loaded_at"),
        F.lit(25).cast("long").alias("sources_loaded"), key.alias("jobs_loaded"),
        (key + 1).alias("skills_loaded"), (key * 4).alias("job_skills_loaded"))


def loaded_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"sources": table(spark, sf_dir, "nation"), "jobs": table(spark, sf_dir, "orders"),
            "skills": table(spark, sf_dir, "part"), "job_skills": table(spark, sf_dir, "lineitem")}


def order_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as published versions."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("int").alias("version"),
        F.col("o_orderkey").cast("string").alias("run_id"))


def view_names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A view for each customer is expected; those with an order in state P have theirs."""
    def named(rows: DataFrame, number: str) -> DataFrame:
        return rows.select(F.concat(F.lit("vw_"), F.col(number).cast("string")).alias("view_name"))
    return (named(table(spark, sf_dir, "customer"), "c_custkey"),
            named(table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'"), "o_custkey"))


def part_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a skill dictionary with the slips of a filled-in file."""
    part = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.when(part % 50 == 0, "").otherwise(F.concat(F.lit("k"), (part % 1990).cast("string")))
        .alias("skill_key"),
        F.when(part % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("skill_name"),
        F.when(part % 70 == 0, F.lit(None).cast("string")).otherwise(F.col("p_type"))
        .alias("skill_category"),
        F.when(part % 90 == 0, " | ").otherwise(F.concat_ws("|", "p_name", "p_type")).alias("aliases"))


def written_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dates of the orders, written in six ways in turn, and a hard case of a date text."""
    at = F.col("o_orderdate")
    ways = [F.date_format(at, "yyyy/M/d"), F.date_format(at, "MMMM d, yyyy"),
            F.concat(F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")),
            F.date_format(at, "d MMM yyyy"), F.unix_timestamp(at).cast("string"),
            F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")]
    return table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(
        F.array(*ways), (F.col("o_orderkey") % 6 + 1).cast("int")).alias("written"),
        dealt(DATE_CASES, "o_orderkey").alias("case"))


# Hard cases that the tables do not hold, dealt over their rows, with the expected value.

HTML_CASES = (
    ("pay < 50k and > 20k ok", "pay < 50k and > 20k ok"),
    ("<p title='a>b'>t</p>", "t"),
    ('<a href="x>y" class=\'q"\'>in</a> out', "in out"),
    ("a &#38;amp; b", "a &amp; b"),
    ("a &amp;lt; b", "a &lt; b"),
    ("don&#146;t &#x80;5", "don’t €5"),
    ("caf&eacute; &uuml;ber &rarr; &copy 2020 &NotEqualTilde;", "café über → © 2020 ≂̸"),
    ("&#00000038; &#x000026 &#0; &#xD800; &#99999999;", "& & &#0; &#xD800; &#99999999;"),
    ("R&D &nosuch; &;&# &#x; AT&T &ampersand", "R&D &nosuch; &;&# &#x; AT&T &ersand"),
    ("a<!-- <b>no</b> -->b<script>if (a<b) x()</script>c<style>p{}</style >d<br/>e", "a b c d e"),
    ("1<2 x</p >y<3", "1<2 x y<3"),
)

DATE_CASES = (
    ("1700000000", "2023-11-14 22:13:20"), ("nan", None), ("Infinity", None), ("1e30", None),
    ("99999999999999999", None), ("-99999999999999", None), ("2025/01/05", "2025-01-05 00:00:00"),
    ("January 5, 2025", "2025-01-05 00:00:00"), ("Sun, 05 Jan 2025 10:20:30 GMT", "2025-01-05 10:20:30"),
    ("Sunday, 5 January 2025", "2025-01-05 00:00:00"), ("05 Jan 2025 10:20:30 +0200", "2025-01-05 08:20:30"),
    ("1/5/2025 7:08", "2025-01-05 07:08:00"), ("2026-07-08T13:02:27+02:00", "2026-07-08 11:02:27"),
    ("2026-13-40", None), ("soon", None), ("", None),
)


def dealt(cases: tuple, number: str) -> Column:
    """The input of the case that a row's number falls on."""
    inputs = F.array(*[F.lit(c[0]) for c in cases])
    return F.element_at(inputs, (F.col(number) % len(cases) + 1).cast("int"))
