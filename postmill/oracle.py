"""The registered queries as plain SQL over the same tables.

Written for a second engine, independently of the DataFrame code: distinct
counts, self joins and cross joins stand where the Spark side avoids them.
"""

from __future__ import annotations

import re

from postmill.bindings import (DATE_CASES, HTML_CASES, SKILL_SENTENCES, TEXT_RULE, TEXT_RULES, TEXT_SKILL_ROWS,
                               TITLE_SKILL_ROWS, TITLES)
from postmill.fixed import RELEVANT_TITLE, ROLE_RULES, SKILLS
from postmill.functions.matching import STUDY_FIELD_RULE

BASKET = """
jobs AS (
  SELECT o_orderkey AS source_record_key, 'status ' || o_orderstatus AS source,
         o_orderpriority AS role_family, o_custkey AS company_name,
         CASE WHEN o_orderkey % 4 IN (1, 3) THEN o_totalprice * 0.75 END AS salary_min,
         CASE WHEN o_orderkey % 4 IN (2, 3) THEN o_totalprice END AS salary_max,
         CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS salary_currency,
         CASE WHEN o_orderkey % 11 <> 0 THEN c_mktsegment END AS salary_period
  FROM orders JOIN customer ON o_custkey = c_custkey),
skills AS (
  SELECT DISTINCT lower(replace(p_brand, '#', '_')) AS skill_key, p_brand AS skill_name,
         'group ' || (CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) % 5) AS skill_category
  FROM part),
bridge AS (
  SELECT DISTINCT l_orderkey AS source_record_key,
         lower(replace(p_brand, '#', '_')) AS skill_key
  FROM lineitem JOIN part ON l_partkey = p_partkey),
role_jobs AS (SELECT role_family, count(*) AS role_job_count FROM jobs GROUP BY 1),
tagged AS (SELECT b.source_record_key, b.skill_key, j.role_family
           FROM bridge b JOIN jobs j USING (source_record_key)),
role_demand AS (
  SELECT t.role_family, s.skill_key, s.skill_name, s.skill_category,
         count(DISTINCT t.source_record_key) AS skill_job_count, r.role_job_count,
         round(100.0::DOUBLE * count(DISTINCT t.source_record_key) / r.role_job_count, 2)
           AS role_skill_share_pct
  FROM tagged t JOIN skills s ON s.skill_key = t.skill_key
  JOIN role_jobs r ON r.role_family = t.role_family
  GROUP BY t.role_family, s.skill_key, s.skill_name, s.skill_category, r.role_job_count)
"""

PAIRS = """,
single AS (SELECT skill_key, count(DISTINCT source_record_key) AS n FROM bridge GROUP BY 1),
pairs AS (
  SELECT a.skill_key AS k1, b.skill_key AS k2, count(DISTINCT a.source_record_key) AS n
  FROM bridge a JOIN bridge b
    ON a.source_record_key = b.source_record_key AND a.skill_key < b.skill_key
  GROUP BY 1, 2),
cooccurrence AS (
  SELECT k1 AS skill_1_key, s1.skill_name AS skill_1_name, k2 AS skill_2_key,
         s2.skill_name AS skill_2_name, c1.n AS skill_1_jobs, c2.n AS skill_2_jobs,
         p.n AS cooccurrence_jobs,
         round(100.0::DOUBLE * p.n / (SELECT count(*) FROM jobs), 2) AS pair_job_share_pct,
         round(100.0::DOUBLE * p.n / c1.n, 2) AS pct_skill_1_with_skill_2,
         round(100.0::DOUBLE * p.n / c2.n, 2) AS pct_skill_2_with_skill_1,
         round(1.0::DOUBLE * p.n / (c1.n + c2.n - p.n), 4) AS jaccard_similarity,
         round(1.0::DOUBLE * p.n * (SELECT count(*) FROM jobs) / (c1.n * c2.n), 4) AS lift
  FROM pairs p JOIN skills s1 ON s1.skill_key = k1 JOIN skills s2 ON s2.skill_key = k2
  JOIN single c1 ON c1.skill_key = k1 JOIN single c2 ON c2.skill_key = k2)
"""

ROLE_PAIRS = """,
role_single AS (
  SELECT role_family, skill_key, count(DISTINCT source_record_key) AS n FROM tagged GROUP BY 1, 2),
role_pairs AS (
  SELECT a.role_family, a.skill_key AS k1, b.skill_key AS k2,
         count(DISTINCT a.source_record_key) AS n
  FROM tagged a JOIN tagged b
    ON a.source_record_key = b.source_record_key AND a.skill_key < b.skill_key
  GROUP BY 1, 2, 3),
role_cooccurrence AS (
  SELECT p.role_family, k1 AS skill_1_key, s1.skill_name AS skill_1_name, k2 AS skill_2_key,
         s2.skill_name AS skill_2_name, c1.n AS skill_1_jobs, c2.n AS skill_2_jobs,
         p.n AS cooccurrence_jobs, r.role_job_count,
         round(100.0::DOUBLE * p.n / r.role_job_count, 2) AS pair_role_share_pct,
         round(100.0::DOUBLE * p.n / c1.n, 2) AS pct_skill_1_with_skill_2,
         round(100.0::DOUBLE * p.n / c2.n, 2) AS pct_skill_2_with_skill_1,
         round(1.0::DOUBLE * p.n / (c1.n + c2.n - p.n), 4) AS jaccard_similarity,
         round(1.0::DOUBLE * p.n * r.role_job_count / (c1.n * c2.n), 4) AS lift
  FROM role_pairs p JOIN role_jobs r USING (role_family)
  JOIN skills s1 ON s1.skill_key = k1 JOIN skills s2 ON s2.skill_key = k2
  JOIN role_single c1 ON c1.role_family = p.role_family AND c1.skill_key = k1
  JOIN role_single c2 ON c2.role_family = p.role_family AND c2.skill_key = k2)
"""

KNOWN = "['brand_1', 'brand_2', 'brand_3', 'brand_4']"

# A job's skills as a list: how many there are, and how many of the known ones.
PROFILE = f""",
held AS (SELECT source_record_key, list(skill_key) AS have FROM bridge GROUP BY 1),
baseline AS (
  SELECT role_family, source_record_key, coalesce(have, []) AS have, len(coalesce(have, [])) AS d,
         len(list_intersect(coalesce(have, []), {KNOWN})) AS m
  FROM jobs LEFT JOIN held USING (source_record_key))
"""

# What learning one more skill changes, by arithmetic over the list of a role's jobs: a job
# that asks for the skill then has one more match, any other job stays as it is.
WHAT_IF = PROFILE + f""",
crews AS (
  SELECT role_family, list({{'d': d, 'm': m, 'have': have}}) AS crew
  FROM baseline WHERE d > 0 GROUP BY role_family),
offers AS (
  SELECT r.*, crew, list_filter(crew, lambda j: list_contains(j.have, r.skill_key)) AS asking,
         list_avg(list_transform(crew, lambda j: 100.0::DOUBLE * j.m / j.d)) AS before,
         list_avg(list_transform(crew, lambda j: 100.0::DOUBLE
           * (j.m + list_contains(j.have, r.skill_key)::INTEGER) / j.d)) AS after
  FROM role_demand r JOIN crews USING (role_family) WHERE NOT list_contains({KNOWN}, r.skill_key)),
gains AS (
  SELECT role_family, skill_key, skill_name, skill_category, skill_job_count,
         role_skill_share_pct AS role_demand_pct, round(before, 2) AS baseline_avg_coverage_pct,
         round(after, 2) AS new_avg_coverage_pct,
         round(after - before, 2) AS marginal_coverage_gain_pct_points,
         CAST(len(list_filter(asking, lambda j: j.d IN (2 * j.m + 1, 2 * j.m + 2))) AS BIGINT)
           AS jobs_newly_reaching_50pct,
         CAST(len(list_filter(asking, lambda j: j.m = 2)) AS BIGINT) AS jobs_newly_reaching_3_matches
  FROM offers)
"""

SCALED = PROFILE + f""",
role_base AS (
  SELECT role_family, count(*) FILTER (d > 0) AS n,
         avg(100.0::DOUBLE * m / d) FILTER (d > 0) AS base
  FROM baseline GROUP BY 1),
gains AS (
  SELECT rd.role_family, rd.skill_key, rd.skill_name, rd.skill_category, rd.skill_job_count,
         rd.role_skill_share_pct AS role_demand_pct, round(rb.base, 2) AS baseline_avg_coverage_pct,
         round(rb.base + sum(100.0::DOUBLE / bl.d) / rb.n, 2) AS new_avg_coverage_pct,
         round(sum(100.0::DOUBLE / bl.d) / rb.n, 2) AS marginal_coverage_gain_pct_points,
         count(*) FILTER (2 * bl.m < bl.d AND 2 * (bl.m + 1) >= bl.d) AS jobs_newly_reaching_50pct,
         count(*) FILTER (bl.m = 2) AS jobs_newly_reaching_3_matches
  FROM role_demand rd JOIN role_base rb ON rb.role_family = rd.role_family
  JOIN bridge b ON b.skill_key = rd.skill_key AND NOT list_contains({KNOWN}, rd.skill_key)
  JOIN baseline bl ON bl.source_record_key = b.source_record_key
                  AND bl.role_family = rd.role_family
  GROUP BY rd.role_family, rd.skill_key, rd.skill_name, rd.skill_category, rd.skill_job_count,
           rd.role_skill_share_pct, rb.base, rb.n)
"""

# Averages and scores that may end in exactly half a unit of the last digit are
# computed in whole numbers, so that no order of addition decides them.

def exact_mean(expr: str) -> str:
    units = f"CAST(sum(CAST({expr} AS DECIMAL(28, 8))) * 100000000 AS HUGEINT)"
    return (f"((2 * {units} + count({expr}) * 1000000) "
            f"// (2 * nullif(count({expr}), 0) * 1000000)) / 100.0::DOUBLE")


# P(missing | known): of the role's jobs with a known skill, the share that has the missing one.
PRIORITY = f""",
urgent AS (SELECT source_record_key, skill_key FROM tagged WHERE role_family = '1-URGENT'),
asked AS (SELECT unnest({KNOWN}) AS known_key),
known_jobs AS (
  SELECT known_key, count(*) AS n_known FROM asked JOIN urgent ON skill_key = known_key GROUP BY 1),
shared AS (
  SELECT u.skill_key, v.skill_key AS known_key, count(*) AS n
  FROM urgent u JOIN urgent v USING (source_record_key)
  WHERE list_contains({KNOWN}, v.skill_key) GROUP BY ALL),
links AS (
  SELECT * EXCLUDE (n), coalesce(n, 0) AS n, coalesce(round(100.0::DOUBLE * n / n_known, 2), 0) AS pct
  FROM (SELECT r.*, known_key FROM role_demand r, asked
        WHERE role_family = '1-URGENT' AND NOT list_contains({KNOWN}, r.skill_key))
  LEFT JOIN shared USING (skill_key, known_key) LEFT JOIN known_jobs USING (known_key)),
scored AS (
  SELECT skill_key, skill_name, skill_category, skill_job_count, role_job_count,
         role_skill_share_pct AS role_demand_pct,
         CAST(sum(CAST(round(pct * 100) AS BIGINT)) AS BIGINT) AS pct_cents, count(*) AS k,
         count(*) FILTER (n > 0) AS known_skill_connections,
         CAST(sum(n) AS BIGINT) AS summed_pair_support
  FROM links
  GROUP BY skill_key, skill_name, skill_category, skill_job_count, role_job_count,
           role_skill_share_pct),
weighed AS (
  SELECT *, 8 * k * CAST(round(role_demand_pct * 100) AS BIGINT) + 2 * pct_cents AS weight
  FROM scored)
"""


def basket(body: str, *parts: str) -> str:
    return "WITH " + BASKET + "".join(parts) + body


def basket_queries() -> dict[str, str]:
    gain_columns = """skill_key, skill_name, skill_category, skill_job_count, role_demand_pct,
      baseline_avg_coverage_pct, new_avg_coverage_pct, marginal_coverage_gain_pct_points,
      jobs_newly_reaching_50pct, jobs_newly_reaching_3_matches"""
    return {
        "skill_demand": basket("""
SELECT skill_key, skill_name, skill_category, count(DISTINCT source_record_key) AS job_count,
       round(100.0::DOUBLE * count(DISTINCT source_record_key) / (SELECT count(*) FROM jobs), 2)
         AS job_share_pct
FROM bridge JOIN skills USING (skill_key) GROUP BY 1, 2, 3"""),
        "role_summary": basket("""
SELECT role_family, count(*) AS job_count,
       round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM jobs), 2) AS job_share_pct,
       count(DISTINCT company_name) AS company_count
FROM jobs GROUP BY 1"""),
        "role_skill_demand": basket("SELECT * FROM role_demand"),
        "skill_cooccurrence": basket("SELECT * FROM cooccurrence", PAIRS),
        "role_skill_cooccurrence": basket("SELECT * FROM role_cooccurrence", ROLE_PAIRS),
        "salary_by_role": basket(f"""
SELECT role_family, salary_currency, salary_period, count(*) AS salary_job_count,
       {exact_mean("salary_min")} AS avg_salary_min, {exact_mean("salary_max")} AS avg_salary_max,
       {exact_mean("CASE WHEN salary_min IS NULL THEN salary_max WHEN salary_max IS NULL "
                   "THEN salary_min ELSE (salary_min + salary_max) / 2.0::DOUBLE END")}
         AS avg_salary_midpoint
FROM jobs
WHERE coalesce(salary_min, salary_max) IS NOT NULL
  AND salary_currency IS NOT NULL AND salary_period IS NOT NULL
GROUP BY 1, 2, 3"""),
        "skill_priority": basket("""
SELECT skill_key, skill_name, skill_category, skill_job_count, role_job_count, role_demand_pct,
       ((2 * pct_cents + k) // (2 * k)) / 100.0::DOUBLE AS avg_complementarity_pct,
       known_skill_connections, summed_pair_support,
       ((2 * weight + 10 * k) // (20 * k)) / 100.0::DOUBLE AS priority_score,
       CASE WHEN weight >= 45000 * k THEN 'High Priority'
            WHEN weight >= 25000 * k THEN 'Medium Priority'
            ELSE 'Lower Priority' END AS priority_tier
FROM weighed""", PRIORITY),
        "profile_coverage": basket("""
, covered AS (SELECT *, CASE WHEN d > 0 THEN 100.0::DOUBLE * m / d END AS pct
              FROM baseline WHERE role_family = '1-URGENT')
SELECT count(*) AS target_jobs, count(*) FILTER (d > 0) AS jobs_with_detected_skills,
       round(avg(pct), 2) AS avg_observed_skill_coverage_pct,
       count(*) FILTER (m >= 1) AS jobs_with_1_plus_matches,
       round(100.0::DOUBLE * count(*) FILTER (m >= 1) / count(*), 2)
         AS jobs_with_1_plus_matches_pct,
       count(*) FILTER (m >= 3) AS jobs_with_3_plus_matches,
       round(100.0::DOUBLE * count(*) FILTER (m >= 3) / count(*), 2)
         AS jobs_with_3_plus_matches_pct,
       count(*) FILTER (pct >= 50) AS jobs_at_50pct_plus_coverage,
       round(100.0::DOUBLE * count(*) FILTER (pct >= 50) / count(*), 2)
         AS jobs_at_50pct_plus_coverage_pct
FROM covered""", PROFILE),
        "marginal_gain": basket(f"SELECT {gain_columns} FROM gains WHERE role_family = '1-URGENT'",
                                WHAT_IF),
        "marginal_gain_scaled": basket(f"SELECT role_family, {gain_columns} FROM gains", SCALED),
        "market_kpis": basket("""
SELECT (SELECT count(*) FROM jobs) AS postings,
       (SELECT count(DISTINCT company_name) FROM jobs) AS companies,
       (SELECT count(*) FROM skills) AS skills_tracked, count(*) AS relationships,
       count(DISTINCT source_record_key) AS jobs_with_skills,
       round(100.0::DOUBLE * count(DISTINCT source_record_key) / (SELECT count(*) FROM jobs), 2)
         AS coverage_pct,
       round(count(*)::DOUBLE / (SELECT count(*) FROM jobs), 2) AS avg_skills_per_job
FROM bridge"""),
        "role_overview": basket("""
SELECT role_family, count(*) AS job_count,
       round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM jobs), 2) AS job_share_pct,
       count(DISTINCT company_name) AS company_count,
       CASE WHEN count(*) >= 30 THEN 'Higher confidence'
            WHEN count(*) >= 15 THEN 'Moderate confidence'
            ELSE 'Limited confidence' END AS sample_confidence
FROM jobs GROUP BY 1"""),
        "role_explorer_topk": basket("""
SELECT * FROM role_demand
QUALIFY row_number() OVER (PARTITION BY role_family ORDER BY skill_job_count DESC, skill_key) <= 5"""),
        "role_explorer_top_pairs": basket("""
SELECT * FROM role_cooccurrence
QUALIFY row_number() OVER (PARTITION BY role_family
  ORDER BY cooccurrence_jobs DESC, skill_1_key, skill_2_key) <= 5""", ROLE_PAIRS),
        "frequent_pairs": basket("""
SELECT * FROM cooccurrence ORDER BY cooccurrence_jobs DESC, skill_1_key, skill_2_key LIMIT 10""",
                                 PAIRS),
        "assoc_min_support": basket("""
SELECT * FROM cooccurrence WHERE cooccurrence_jobs >= 20
ORDER BY lift DESC, cooccurrence_jobs DESC, skill_1_key, skill_2_key LIMIT 10""", PAIRS),
        "comparable_salaries": basket(f"""
SELECT role_family, salary_currency, salary_period, count(*) AS salary_job_count,
       {exact_mean("salary_min")} AS avg_salary_min, {exact_mean("salary_max")} AS avg_salary_max,
       {exact_mean("coalesce((salary_min + salary_max) / 2.0::DOUBLE, salary_min, salary_max)")}
         AS avg_salary_midpoint
FROM jobs
WHERE (salary_min IS NOT NULL OR salary_max IS NOT NULL)
  AND salary_currency = 'F' AND salary_period = 'BUILDING'
GROUP BY 1, 2, 3"""),
        "warehouse_summary": basket("""
SELECT 'source' AS part, source AS name, count(*) AS job_count FROM jobs GROUP BY source
UNION ALL
SELECT 'skill', skill_name, job_count FROM (
  SELECT skill_key, skill_name, count(*) AS job_count FROM bridge JOIN skills USING (skill_key)
  GROUP BY 1, 2 ORDER BY job_count DESC, skill_name LIMIT 10)"""),
    }


# --- text --------------------------------------------------------------------

def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def squashed(expr: str) -> str:
    return rf"trim(regexp_replace({expr}, '\s+', ' ', 'g'))"


def url_free(expr: str) -> str:
    return squashed(rf"regexp_replace({expr}, '(?i)https?://\S+|www\.\S+', ' ', 'g')")


def plain(expr: str) -> str:
    """Letters outside ASCII become 'x', so that ASCII word boundaries fall as
    Unicode ones would."""
    return rf"regexp_replace({expr}, '[^\x00-\x7f]', 'x', 'g')"


def family(title: str, rules) -> str:
    text = f"lower({plain(squashed(title))})"
    cases = " ".join(f"WHEN regexp_matches({text}, {quoted(p)}) THEN {quoted(f)}" for f, p in rules)
    return f"CASE {cases} ELSE 'Non-target Role' END"


POSTS = """
posts AS (
  SELECT source || '::' || doc_id AS source_record_key, source,
         CAST(doc_id AS VARCHAR) AS source_job_id, split_part(text, chr(10), 1) AS job_title_raw,
         lang AS tags, text AS description_text, source AS company_name, lang AS role_family,
         lang AS location_raw, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS publication_date,
         'https://example.com/' || doc_id AS job_url, 'query ' || lang AS search_queries
  FROM documents)
"""

REVIEWS = """,
reviews AS (
  SELECT CAST(doc_id AS VARCHAR) AS source_job_id, 'Document ' || doc_id AS job_title_raw,
         CASE WHEN doc_id % 9 IN (0, 1) THEN 'Unverified'
              WHEN quality = 1 AND toxic = 0 THEN 'Correct'
              WHEN quality = 0 THEN 'False Positive'
              ELSE 'Incorrect Role Family' END AS manual_decision,
         CASE WHEN quality = 0 THEN 'Non-target Role' WHEN toxic = 1 THEN 'Analytics Engineer'
              WHEN doc_id % 2 = 0 THEN 'Data Analyst' ELSE 'Data Engineer' END
           AS correct_role_family,
         CASE WHEN toxic = 1 THEN 'see notes' ELSE '' END AS review_notes
  FROM labels),
overrides AS (
  SELECT d.source, r.source_job_id, r.correct_role_family, r.manual_decision
  FROM reviews r JOIN documents d ON r.source_job_id = CAST(d.doc_id AS VARCHAR)
  WHERE r.manual_decision <> 'Unverified')
"""

CLASSIFIED = POSTS + REVIEWS + f""",
ruled AS (SELECT *, {family("job_title_raw", TEXT_RULES)} AS automated_role_family
          FROM (SELECT * EXCLUDE (role_family) FROM posts)),
classified AS (
  SELECT r.*, coalesce(o.correct_role_family, r.automated_role_family) AS role_family,
         CASE WHEN o.source IS NULL THEN 'Automated Rule' ELSE 'Manual Override' END
           AS classification_method,
         o.source IS NOT NULL AS role_override_applied,
         coalesce(o.manual_decision, '') AS override_decision,
         coalesce(o.correct_role_family, r.automated_role_family) <> 'Non-target Role'
           AS is_target_data_role
  FROM ruled r LEFT JOIN overrides o USING (source, source_job_id)),
evaluated AS (
  SELECT o.*, r.job_title_raw, r.company_name, r.automated_role_family,
         r.automated_role_family <> 'Non-target Role' AS predicted_is_target,
         o.correct_role_family <> 'Non-target Role' AS actual_is_target
  FROM overrides o JOIN ruled r USING (source, source_job_id))
"""


def _alias_rows(skills) -> str:
    rows = []
    for key, name, category, aliases in skills:
        for alias in aliases.split("|"):
            body = r"\s+".join(re.escape(w) for w in alias.split())
            rows.append(f"({quoted(key)}, {quoted(name)}, {quoted(alias)}, {quoted(body)})")
    return "VALUES " + ", ".join(rows)


def _any_of(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(t)})" for t in terms) + ")"


def _matches(skills, rule) -> str:
    """Bridge of `posts`; hits of the rule's skill carry 120 characters either side."""
    return rf""",
dict(skill_key, skill_name, alias, body) AS ({_alias_rows(skills)}),
fields AS (
  SELECT source_record_key, f.name AS field, {url_free("f.txt")} AS txt
  FROM posts, LATERAL (VALUES ('job_title_raw', job_title_raw), ('tags', tags),
                              ('description_text', description_text)) f(name, txt)),
hits AS (
  SELECT source_record_key, field, skill_key, skill_name, alias,
         CASE WHEN skill_key = {quoted(rule.skill)} THEN
           lower(regexp_extract(txt, '(?is).{{0,119}}?(^|[^A-Za-z0-9_])' || body
                                     || '($|[^A-Za-z0-9_].{{0,119}})', 0)) END AS around
  FROM fields, dict
  WHERE regexp_matches(txt, '(?i)(^|[^A-Za-z0-9_])' || body || '([^A-Za-z0-9_]|$)')),
kept AS (
  SELECT * FROM hits
  WHERE NOT (skill_key = {quoted(rule.skill)} AND {_any_of("around", rule.when_terms)}
             AND NOT {_any_of("around", rule.unless_terms)})),
evidence AS (
  SELECT source_record_key, skill_key, string_agg(field, '|' ORDER BY field) AS evidence_source,
         CAST(count(*) AS INTEGER) AS evidence_field_count
  FROM (SELECT DISTINCT source_record_key, skill_key, field FROM kept) GROUP BY 1, 2),
bridge AS (
  SELECT e.*, a.matched_aliases
  FROM evidence e JOIN (
    SELECT source_record_key, skill_key,
           string_agg(alias, '|' ORDER BY lower(alias), alias) AS matched_aliases
    FROM (SELECT DISTINCT source_record_key, skill_key, alias FROM kept) GROUP BY 1, 2) a
    USING (source_record_key, skill_key))
"""


MATCHES = POSTS + _matches(TEXT_SKILL_ROWS, TEXT_RULE) + """,
rejected AS (SELECT d.source || '::' || d.doc_id AS source_record_key, 'that_word' AS skill_key
             FROM labels JOIN documents d USING (doc_id) WHERE toxic = 1),
names AS (SELECT DISTINCT skill_key, skill_name FROM dict),
audit AS (
  SELECT p.*, coalesce(s.n, 0)::INTEGER AS detected_skill_count,
         coalesce(s.list, '') AS detected_skills
  FROM posts p LEFT JOIN (
    SELECT source_record_key, count(*) AS n,
           string_agg(skill_name, '|' ORDER BY lower(skill_name), skill_name) AS list
    FROM bridge JOIN names USING (skill_key) GROUP BY 1) s USING (source_record_key))
"""

def _around(field: str) -> str:
    """120 characters before the first alias that a field holds, and 180 after it."""
    text = squashed(field)
    alias = f"list_filter(string_split(matched_aliases, '|'), lambda a: contains(lower({text}), lower(a)))[1]"
    at = f"strpos(lower({text}), lower({alias}))"
    start = f"greatest({at} - 121, 0)"
    return (f"CASE WHEN {alias} IS NOT NULL THEN trim(substr({text}, {start} + 1, "
            f"least(length({text}), {at} - 1 + length({alias}) + 180) - {start})) END")


# The aliases dealt here, and the texts, hold no letter that changes its length in lower case.
EXCERPTS = f"""
excerpts AS (
  SELECT b.*, coalesce({_around("job_title_raw")}, {_around("tags")}, {_around("description_text")},
                       left({squashed("description_text")}, 300)) AS evidence_excerpt
  FROM bridge b JOIN posts p USING (source_record_key))"""

FINGERPRINTS = POSTS + f""",
marked AS (SELECT *, left(sha256(lower({squashed("tags")}) || '|'
                     || lower({squashed("description_text")}) || '|'
                     || lower({squashed("location_raw")})), 20) AS job_fingerprint FROM posts)
"""


def duplicates(table: str, columns: str) -> str:
    return f"""
SELECT CASE WHEN source_count > 1 THEN 'Cross-source' ELSE 'Within-source' END AS duplicate_scope,
       job_fingerprint, record_count, source_count, {columns}
FROM {table} JOIN (
  SELECT job_fingerprint, count(*) AS record_count, count(DISTINCT source) AS source_count
  FROM {table} GROUP BY 1 HAVING count(*) > 1) USING (job_fingerprint)"""


# The references that the pages hold; the hard cases are stated as values.
PAGE_REFERENCES = (("quot", '"'), ("middot", "·"), ("copy", "©"), ("amp", "&"))


def _html() -> str:
    text = "html"
    for pattern in (r"(?s)<!--.*?-->", r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>",
                    r"""<([A-Za-z]|/[A-Za-z]|[!?])([^>"']|"[^"]*"|'[^']*')*>"""):
        text = f"regexp_replace({text}, {quoted(pattern)}, ' ', 'g')"
    for name, char in PAGE_REFERENCES:
        text = f"replace({text}, '&{name};', {quoted(char)})"
    return squashed(text)


def dealt(values, number: str) -> str:
    """The value of a fixed list that a row's number falls on."""
    return f"list_extract([{', '.join(values)}], {number} % {len(values)} + 1)"


REVIEW_QUEUE = f"""
WITH {CLASSIFIED},
flagged AS (
  SELECT *, role_family IN ('Other Analytics', 'Business Analyst', 'Power BI',
                            'Analytics Manager') AS vague,
         role_family = 'Non-target Role' AS off,
         regexp_matches({plain("job_title_raw")}, {quoted(RELEVANT_TITLE)}) AS relevant
  FROM classified),
reasons AS (
  SELECT *, concat_ws(' | ', CASE WHEN vague THEN 'Ambiguous standardized role' END,
                      CASE WHEN off AND relevant THEN 'Possible false negative' END,
                      CASE WHEN NOT off AND NOT relevant THEN 'Possible false positive' END)
           AS review_reason
  FROM flagged)
SELECT CASE WHEN off = relevant THEN 'High' ELSE 'Medium' END AS review_priority, review_reason,
       source_job_id, job_title_raw, role_family, is_target_data_role, company_name,
       search_queries, '' AS manual_decision, '' AS correct_role_family, '' AS review_notes, job_url
FROM reasons WHERE review_reason <> ''"""

SKILLED_POSTS = POSTS.replace("text AS description_text", "text || ' ' || " + dealt(
    [quoted(t) for t in SKILL_SENTENCES], "doc_id") + " AS description_text")

WORD_PAIRS = """
WITH words AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[a-z]{3,}')) AS w FROM documents),
least AS (SELECT greatest(2, count(*) // 10) AS need, count(*) AS jobs FROM documents),
often AS (SELECT w, count(*) AS n FROM words GROUP BY w HAVING count(*) >= (SELECT need FROM least)),
held AS (SELECT doc_id, w, o.n FROM words JOIN often o USING (w)),
pairs AS (
  SELECT a.w AS w1, b.w AS w2, any_value(a.n) AS n1, any_value(b.n) AS n2, count(*) AS n
  FROM held a JOIN held b ON a.doc_id = b.doc_id AND a.w < b.w GROUP BY 1, 2
  HAVING count(*) >= (SELECT need FROM least))
SELECT w1 AS skill_1_key, w2 AS skill_2_key, n1 AS skill_1_jobs, n2 AS skill_2_jobs,
       n AS cooccurrence_jobs, round(100.0::DOUBLE * n / jobs, 2) AS pair_job_share_pct,
       round(100.0::DOUBLE * n / n1, 2) AS pct_skill_1_with_skill_2,
       round(100.0::DOUBLE * n / n2, 2) AS pct_skill_2_with_skill_1,
       round(1.0::DOUBLE * n / (n1 + n2 - n), 4) AS jaccard_similarity,
       round(1.0::DOUBLE * n * jobs / (n1 * n2), 4) AS lift
FROM pairs, least"""

WORD_RULES = f"""
WITH {POSTS},
rules AS (SELECT DISTINCT w, md5(w) AS rule_no, 'Family ' || length(w) AS family
          FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS w FROM benchmark)),
met AS (
  SELECT source, source_job_id, min(struct_pack(rule_no := rule_no, family := family)) AS first
  FROM posts JOIN rules ON regexp_matches(lower({squashed("job_title_raw")}),
                                          '(^|[^a-z0-9])' || w || '([^a-z0-9]|$)')
  GROUP BY 1, 2)
SELECT p.source, p.source_job_id, coalesce(first.family, 'Non-target Role') AS role_family,
       first.rule_no AS rule_no
FROM posts p LEFT JOIN met m ON p.source = m.source AND p.source_job_id = m.source_job_id"""


def text_queries() -> dict[str, str]:
    title = f"list_extract([{', '.join(quoted(t) for t in TITLES)}], o_orderkey % {len(TITLES)} + 1)"
    return {
        "classify_titles": f"""
WITH t AS (SELECT CAST(o_orderkey AS VARCHAR) AS source_job_id, {title} AS job_title_raw FROM orders),
r AS (SELECT *, {family("job_title_raw", ROLE_RULES)} AS automated_role_family FROM t)
SELECT 'orders' AS source, source_job_id, job_title_raw, automated_role_family,
       automated_role_family AS role_family, 'Automated Rule' AS classification_method,
       false AS role_override_applied, '' AS override_decision,
       automated_role_family <> 'Non-target Role' AS is_target_data_role
FROM r""",
        "classify_with_overrides": f"""
WITH {CLASSIFIED}
SELECT source, source_job_id, automated_role_family, role_family, classification_method,
       role_override_applied, override_decision, is_target_data_role FROM classified""",
        "changed_predictions": f"""
WITH {CLASSIFIED}
SELECT count(*) FILTER (automated_role_family <> role_family) AS changed_predictions
FROM classified""",
        "review_queue": REVIEW_QUEUE,
        "ranked_reviews": f"""
SELECT *, row_number() OVER (ORDER BY review_priority = 'Medium', role_family, job_title_raw,
                                      source_job_id) AS row_rank FROM ({REVIEW_QUEUE})""",
        "prepare_overrides": f"""
WITH {POSTS} {REVIEWS}
SELECT source_job_id, job_title_raw, manual_decision, correct_role_family,
       correct_role_family <> 'Non-target Role' AS is_target_data_role_override, review_notes
FROM reviews WHERE manual_decision <> 'Unverified'""",
        "classifier_metrics": f"""
WITH {CLASSIFIED},
c AS (SELECT count(*) AS n, count(*) FILTER (automated_role_family = correct_role_family) AS hit,
             count(*) FILTER (predicted_is_target AND actual_is_target) AS tp,
             count(*) FILTER (predicted_is_target AND NOT actual_is_target) AS fp,
             count(*) FILTER (NOT predicted_is_target AND actual_is_target) AS fn,
             count(*) FILTER (NOT predicted_is_target AND NOT actual_is_target) AS tn
      FROM evaluated)
SELECT n AS reviewed_records, hit AS exact_role_family_matches,
       n - hit AS exact_role_family_mismatches, hit::DOUBLE / n AS role_family_accuracy,
       tp AS true_positive, fp AS false_positive, fn AS false_negative, tn AS true_negative,
       tp::DOUBLE / (tp + fp) AS target_precision, tp::DOUBLE / (tp + fn) AS target_recall,
       2 * (tp::DOUBLE / (tp + fp)) * (tp::DOUBLE / (tp + fn))
         / (tp::DOUBLE / (tp + fp) + tp::DOUBLE / (tp + fn)) AS target_f1_score
FROM c""",
        "classifier_mismatches": f"""
WITH {CLASSIFIED}
SELECT source_job_id, job_title_raw, company_name, automated_role_family, correct_role_family,
       manual_decision, predicted_is_target, actual_is_target
FROM evaluated WHERE automated_role_family <> correct_role_family""",
        "extract_skills": f"WITH {MATCHES} SELECT * FROM bridge",
        "extract_skills_joined": f"WITH {MATCHES} SELECT * FROM bridge",
        "context_suppression": f"""
WITH {MATCHES},
lists AS (
  SELECT source_record_key, kind, string_agg(alias, '|' ORDER BY lower(alias), alias) AS list
  FROM (SELECT DISTINCT source_record_key, alias, 'all' AS kind FROM hits
        WHERE skill_key = 'license_word'
        UNION ALL
        SELECT DISTINCT source_record_key, alias, 'kept' FROM kept
        WHERE skill_key = 'license_word') GROUP BY 1, 2)
SELECT a.source_record_key, a.list AS without_rule, k.list AS with_rule
FROM lists a LEFT JOIN lists k ON k.source_record_key = a.source_record_key AND k.kind = 'kept'
WHERE a.kind = 'all'""",
        "skill_exclusions": f"""
WITH {MATCHES}
SELECT source_record_key, skill_key FROM bridge
ANTI JOIN rejected USING (source_record_key, skill_key)""",
        "excluded_count": f"""
WITH {MATCHES}
SELECT count(*) AS removed_relations FROM bridge
SEMI JOIN rejected USING (source_record_key, skill_key)""",
        "skill_audit": f"""
WITH {MATCHES}
SELECT source_record_key, source, source_job_id, job_title_raw, company_name, role_family,
       publication_date, detected_skill_count, detected_skills FROM audit""",
        "ranked_audit": f"""
WITH {MATCHES}
SELECT source_record_key, source, source_job_id, job_title_raw, company_name, role_family,
       publication_date, detected_skill_count, detected_skills,
       row_number() OVER (ORDER BY detected_skill_count, role_family, job_title_raw,
                                   source_record_key) AS row_rank FROM audit""",
        "default_skills": f"""
WITH {SKILLED_POSTS} {_matches(SKILLS, STUDY_FIELD_RULE)} SELECT * FROM bridge""",
        "word_associations": WORD_PAIRS,
        "classify_by_table": WORD_RULES,
        "extraction_summary": f"""
WITH {MATCHES}
SELECT (SELECT count(*) FROM posts) AS jobs, count(*) AS relations,
       count(DISTINCT source_record_key) AS jobs_with_skills,
       round(100.0::DOUBLE * count(DISTINCT source_record_key) / (SELECT count(*) FROM posts), 2)
         AS coverage_pct,
       round(count(*)::DOUBLE / (SELECT count(*) FROM posts), 2) AS mean_skills_per_job
FROM bridge""",
        "skill_excerpts": f"""
WITH {MATCHES}, {EXCERPTS}
SELECT source_record_key, skill_key, evidence_excerpt FROM excerpts""",
        "skill_audit_sample": f"""
WITH {MATCHES}, {EXCERPTS},
parts AS (
  SELECT 'Potentially Ambiguous Match' AS audit_type, p.*, e.skill_key, n.skill_name,
         e.evidence_source, e.matched_aliases, '' AS skills, '' AS counted, e.evidence_excerpt
  FROM (SELECT *, row_number() OVER (PARTITION BY skill_key ORDER BY md5(source_record_key || '|42'),
                                     source_record_key) AS draw
        FROM excerpts WHERE skill_key IN ('that_word', 'license_word', 'mail')) e
  JOIN posts p USING (source_record_key) JOIN names n USING (skill_key) WHERE draw <= 2
  UNION ALL
  SELECT 'High Detected Skill Count', * EXCLUDE (detected_skill_count, detected_skills), '', '', '', '',
         detected_skills, CAST(detected_skill_count AS VARCHAR), left({squashed("description_text")}, 300)
  FROM (SELECT * FROM audit ORDER BY detected_skill_count DESC, source_record_key LIMIT 10)
  UNION ALL
  SELECT 'No Skills Detected', * EXCLUDE (detected_skill_count, detected_skills), '', '', '', '', '', '0',
         left({squashed("description_text")}, 300)
  FROM audit WHERE detected_skill_count = 0)
SELECT audit_type, source_record_key, source, source_job_id, job_title_raw, company_name, role_family,
       skill_key, skill_name, evidence_source, matched_aliases, counted AS detected_skill_count,
       skills AS detected_skills, evidence_excerpt, '' AS manual_decision,
       '' AS correct_skill_or_action, '' AS review_notes, job_url
FROM parts""",
        "fingerprint_duplicates": "WITH " + FINGERPRINTS + duplicates(
            "marked", "source, source_job_id, company_name, location_raw, publication_date, job_url"),
        "duplicate_groups": f"""
WITH {FINGERPRINTS}
SELECT CASE WHEN s > 1 THEN 'Cross-source' ELSE 'Within-source' END AS duplicate_scope,
       count(*) AS duplicate_groups, CAST(sum(n) AS BIGINT) AS duplicate_records
FROM (SELECT job_fingerprint, count(*) AS n, count(DISTINCT source) AS s FROM marked
      GROUP BY 1 HAVING count(*) > 1) GROUP BY 1""",
        "html_to_text": f"SELECT page_id, {_html()} AS body FROM pages",
        "html_cases": f"""
SELECT page_id, {squashed(f"{dealt([quoted(c[1]) for c in HTML_CASES], 'page_id')} || ' | ' || {_html()}")} AS body
FROM pages""",
        "number_parse": r"""
SELECT doc_id, CAST(len(n) AS INTEGER) AS numbers, list_min(n) AS least, list_max(n) AS greatest
FROM (SELECT doc_id, list_transform(list_filter(string_split(text, ' '), lambda w: regexp_full_match(
        w, '\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]{1,4})?\s*')),
        lambda w: CAST(trim(w, E' \n\r\t') AS DOUBLE)) AS n FROM documents)""",
        "date_cases": f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (0, 1, 3) THEN date_trunc('day', o_orderdate)
                        ELSE date_trunc('second', o_orderdate) END AS at,
       CAST({dealt(['NULL' if c[1] is None else f"TIMESTAMP '{c[1]}'" for c in DATE_CASES], 'o_orderkey')}
            AS TIMESTAMP) AS case_at FROM orders""",
    }


# --- raw records -------------------------------------------------------------

def titled(number: str) -> str:
    return f"list_extract([{', '.join(quoted(t) for t in TITLES)}], {number} % {len(TITLES)} + 1)"


LANDED = """
landed AS (
  SELECT 'job-' || user_id AS source_job_id, event_type AS _source_query,
         CAST(day(ts) AS INTEGER) AS _source_page, strftime(ts, '%Y%m%d') AS _source_file,
         event_id AS _position, user_id, ts, value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events)
"""


def marked(title: str, company: str, location: str) -> str:
    return (f"left(sha256(lower({company}) || '|' || lower({squashed(title)}) || '|' "
            f"|| lower({location})), 20)")


def corrected(number: str) -> str:
    return f"CASE WHEN {number} % 2 = 0 THEN 'Data Analyst' ELSE 'Non-target Role' END"


STAGED = LANDED + f""",
seen AS (SELECT source_job_id, string_agg(q, '|' ORDER BY q) AS search_queries
         FROM (SELECT DISTINCT source_job_id, _source_query AS q FROM landed) GROUP BY 1),
firsts AS (
  SELECT *, {titled("user_id")} AS title, 'Company ' || user_id % 40 AS company,
         CASE user_id % 3 WHEN 0 THEN 'Worldwide' WHEN 1 THEN 'Canada|Spain' ELSE '' END AS place,
         CASE WHEN k % 3 > 0 THEN k * 1000.0::DOUBLE END AS low,
         CASE WHEN k % 3 > 1 THEN k * 1500 + 0.5::DOUBLE END AS high,
         CASE WHEN k % 4 > 0 THEN 'USD' ELSE '' END AS cur,
         CASE WHEN k % 5 > 0 THEN 'annual' ELSE '' END AS per
  FROM landed
  QUALIFY row_number() OVER (PARTITION BY source_job_id ORDER BY _source_file, _position) = 1),
paged AS (
  SELECT 'Paged' AS source, source_job_id, {marked("title", "company", "place")} AS job_fingerprint,
         {squashed("title")} AS job_title_raw, {family("title", ROLE_RULES)} AS automated_role_family,
         CASE WHEN user_id % 25 = 3 THEN {corrected("user_id")} ELSE automated_role_family END AS role_family,
         user_id % 25 = 3 AS role_override_applied,
         company AS company_name, '' AS company_logo_url, '' AS category,
         replace(array_to_string(list_sort(['sql', 'beta', 'alpha', _source_query]), '|'),
                 'beta', 'Beta') AS tags,
         '' AS job_type, '' AS seniority_raw, date_trunc('second', ts) AS publication_date,
         CAST(NULL AS TIMESTAMP) AS expiry_date, place AS location_raw, '' AS timezone_raw,
         user_id % 3 = 0 AS is_worldwide, low AS salary_min, high AS salary_max,
         cur AS salary_currency, per AS salary_period,
         CASE WHEN low IS NULL AND high IS NULL THEN '' ELSE concat_ws(' ',
           CASE WHEN high IS NULL THEN 'From ' || format('{{:,}}', low::BIGINT)
                WHEN low IS NULL THEN 'Up to ' || format('{{:,.2f}}', high)
                ELSE format('{{:,}}', low::BIGINT) || '–' || format('{{:,.2f}}', high) END,
           nullif(cur, ''), 'per ' || nullif(per, '')) END AS salary_raw,
         'Value ' || CAST(round(value, 2) AS VARCHAR) || ' & more' AS description_text,
         'https://jobs.example.com/' || user_id AS job_url, search_queries,
         strftime(ts, '%Y-%m-%dT00:00:00Z') AS collected_at
  FROM firsts JOIN seen USING (source_job_id)),
lasts AS (
  SELECT *, {titled("o_custkey")} AS title, 'Company ' || o_custkey % 40 AS company,
         CASE WHEN o_custkey % 2 = 0 THEN 'Canada|Spain' ELSE 'Worldwide' END AS place
  FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey
            ORDER BY strftime(o_orderdate, '%Y%m%d') DESC, o_orderkey DESC) = 1),
snapshot AS (
  SELECT 'Snapshot' AS source, CAST(o_custkey AS VARCHAR) AS source_job_id,
         {marked("title", "company", "place")} AS job_fingerprint,
         {squashed("title")} AS job_title_raw, {family("title", ROLE_RULES)} AS automated_role_family,
         CASE WHEN o_custkey % 40 = 7 THEN {corrected("o_custkey")} ELSE automated_role_family END AS role_family,
         o_custkey % 40 = 7 AS role_override_applied,
         company AS company_name, 'https://example.org/logo' AS company_logo_url,
         o_orderpriority AS category,
         array_to_string(list_sort(list_distinct(['b', 'B', 'a', o_orderstatus])), '|') AS tags,
         'full_time' AS job_type, o_orderdate AS publication_date, place AS location_raw,
         CASE WHEN o_orderstatus = 'F' THEN '' ELSE '40k - 50k' END AS salary_raw,
         'Order ' || o_orderkey AS description_text,
         'https://example.org/' || o_custkey AS job_url, '2024-02-01T00:00:00Z' AS collected_at
  FROM lasts),
master AS (
  SELECT lower(source) || '::' || source_job_id AS source_record_key,
         * REPLACE (CAST(replace(collected_at, 'Z', '') AS TIMESTAMP) AS collected_at)
  FROM (SELECT * FROM paged UNION ALL BY NAME SELECT * FROM snapshot))
"""

JUDGED = """role_family <> 'Non-target Role' AS is_target_data_role,
  CASE WHEN role_override_applied THEN 'Manual Override' ELSE 'Automated Rule' END AS classification_method,
  CASE WHEN role_override_applied THEN 'Incorrect Role Family' ELSE '' END AS override_decision"""

CRAWL = LANDED + """,
page_sizes AS (SELECT _source_query, _source_page, count(*) AS page_records FROM landed GROUP BY 1, 2),
first_seen AS (SELECT _source_query, source_job_id, min(_source_page) AS _source_page
               FROM landed GROUP BY 1, 2),
stops AS (
  SELECT q._source_query, coalesce(min(p.n), 32) AS stop
  FROM (SELECT DISTINCT _source_query FROM landed) q
  LEFT JOIN range(1, 32) AS p(n) ON NOT EXISTS (
    SELECT 1 FROM first_seen f
    WHERE f._source_query = q._source_query AND f._source_page = p.n)
  GROUP BY 1),
crawl AS (
  SELECT s._source_query, s._source_page, s.page_records,
         (SELECT count(*) FROM first_seen f WHERE f._source_query = s._source_query
            AND f._source_page = s._source_page) AS new_ids,
         s._source_page < t.stop AS counted
  FROM page_sizes s JOIN stops t ON t._source_query = s._source_query)
"""


def record_queries() -> dict[str, str]:
    ids = "source_job_id, _source_query, _source_page, _source_file, _position"
    ordered = "PARTITION BY source_job_id ORDER BY _source_file {0}, _position {0}"
    return {
        "latest_batch": f"""
WITH {LANDED}
SELECT ' ' || source_job_id AS guid, _source_query, _position FROM landed
WHERE _source_file = (SELECT max(_source_file) FROM landed)""",
        "dedup_first": f"""
WITH {LANDED} SELECT {ids} FROM landed
QUALIFY row_number() OVER ({ordered.format('')}) = 1""",
        "dedup_last": f"""
WITH {LANDED} SELECT {ids} FROM landed
QUALIFY row_number() OVER ({ordered.format('DESC')}) = 1""",
        "repeat_count": f"""
WITH {LANDED} SELECT count(*) - count(DISTINCT source_job_id) AS repeated_rows FROM landed""",
        "duplicate_members": f"""
WITH {LANDED} SELECT {ids}, count(*) OVER (PARTITION BY source_job_id, _source_page) AS group_rows
FROM landed QUALIFY group_rows > 1""",
        "query_overlap": f"""
WITH {STAGED} SELECT job_title_raw, company_name, search_queries FROM paged
WHERE contains(search_queries, '|')""",
        "crawl_pages": f"WITH {CRAWL} SELECT * FROM crawl",
        "crawl_novelty": f"""
WITH {CRAWL}
SELECT _source_query, count(*) AS pages_saved, CAST(sum(page_records) AS BIGINT) AS records_received,
       CAST(sum(new_ids) AS BIGINT) AS unique_ids,
       CAST(sum(page_records) - sum(new_ids) AS BIGINT) AS repeated_records
FROM crawl WHERE counted GROUP BY 1""",
        "crawl_totals": f"""
WITH {CRAWL},
ids AS (SELECT count(DISTINCT l.source_job_id) AS n FROM landed l
        JOIN crawl c USING (_source_query, _source_page) WHERE c.counted)
SELECT count(*) AS pages_saved, CAST(sum(page_records) AS BIGINT) AS records_received,
       (SELECT n FROM ids) AS unique_ids,
       CAST(sum(page_records) - (SELECT n FROM ids) AS BIGINT) AS repeated_records
FROM crawl WHERE counted""",
        "json_fields": """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
        "stage_paged": f"WITH {STAGED} SELECT *, {JUDGED} FROM paged",
        "stage_snapshot": f"WITH {STAGED} SELECT *, {JUDGED} FROM snapshot",
        "staging_report": f"""
WITH {STAGED}
SELECT (SELECT count(*) FROM landed) AS records_received, count(*) AS unique_jobs,
       (SELECT count(*) FROM landed) - count(*) AS repeated_records,
       count(*) FILTER (role_family <> 'Non-target Role') AS target_jobs,
       count(*) FILTER (role_override_applied) AS overrides_applied,
       count(*) FILTER (automated_role_family <> role_family) AS changed_predictions,
       count(*) - count(DISTINCT job_fingerprint) AS duplicate_fingerprints,
       count(*) FILTER (salary_raw = '') AS missing_salary,
       count(*) FILTER (job_title_raw = '') AS missing_titles,
       count(*) FILTER (company_name = '') AS missing_companies,
       count(*) FILTER (publication_date IS NULL) AS missing_publication_dates
FROM paged""",
        "conform_union": f"WITH {STAGED} SELECT *, {JUDGED} FROM master",
        "target_rows": f"""
WITH {STAGED} SELECT source_record_key, role_family, job_fingerprint FROM master
WHERE role_family <> 'Non-target Role'""",
        "source_reconciliation": f"""
WITH {STAGED}
SELECT source, count(*) AS total_records,
       count(*) FILTER (role_family <> 'Non-target Role') AS target_roles,
       count(*) FILTER (role_family = 'Non-target Role') AS non_target_roles,
       count(*) FILTER (role_override_applied) AS overrides_applied,
       count(*) FILTER (salary_raw <> '') AS salary_disclosed,
       count(*) FILTER (salary_raw = '') AS missing_salary,
       count(*) FILTER (publication_date IS NULL) AS missing_publication_dates
FROM master GROUP BY 1""",
        "master_duplicates": "WITH " + STAGED + duplicates(
            "master", "source, source_job_id, company_name, job_title_raw, location_raw, "
            "publication_date, job_url"),
        "bool_parse": f"""
WITH {LANDED} SELECT _position, CASE k WHEN 1 THEN true WHEN 0 THEN false END AS flag FROM landed""",
        "file_provenance": """
SELECT o_orderkey, 'orders.parquet' AS _source_file, row_number() OVER () - 1 AS _position FROM orders""",
        "keep_first_arrival": """
SELECT o_custkey, o_orderkey, _position
FROM (SELECT o_custkey, o_orderkey, row_number() OVER () - 1 AS _position FROM orders)
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY _position) = 1""",
        "ranked_master": f"""
WITH {STAGED}
SELECT source_record_key, publication_date,
       row_number() OVER (ORDER BY publication_date DESC NULLS LAST, source, job_title_raw,
                                   source_record_key) AS row_rank FROM master""",
        "date_parse": """
SELECT event_id AS _position, date_trunc('second', ts) AS published,
       CASE WHEN event_id % 2 = 0 THEN make_timestamp(CAST(epoch(date_trunc('second', ts)) AS BIGINT) * 1000)
            ELSE date_trunc('second', ts) END AS published_ms,
       CAST(NULL AS TIMESTAMP) AS expires
FROM events""",
        "salary_text": """
WITH p AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS low,
         CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice * 4 END AS high,
         CASE WHEN o_orderkey % 5 <> 0 THEN 'usd' END AS cur,
         CASE WHEN o_orderkey % 7 <> 0 THEN 'per annual' END AS per
  FROM orders),
t AS (SELECT *, format('{:,}', low) AS a,
             CASE WHEN high = floor(high) THEN format('{:,}', CAST(high AS BIGINT))
                  ELSE format('{:,.2f}', high) END AS b FROM p)
SELECT o_orderkey, CASE WHEN low IS NULL AND high IS NULL THEN ''
  WHEN high IS NULL THEN concat_ws(' ', 'From ' || a, cur, per)
  WHEN low IS NULL THEN concat_ws(' ', 'Up to ' || b, cur, per)
  ELSE concat_ws(' ', a || '–' || b, cur, per) END AS salary
FROM t""",
    }


LOADED = STAGED + f""",
target AS (SELECT * FROM master WHERE role_family <> 'Non-target Role'),
terms(skill_key, alias) AS (VALUES {", ".join(
    f"({quoted(key)}, {quoted(alias)})" for key, _, _, aliases in TITLE_SKILL_ROWS
    for alias in aliases.split("|"))}),
words AS (
  SELECT source_record_key, f.name AS field, ' ' || regexp_replace(lower(f.txt), '[^a-z0-9_]+', ' ', 'g')
         || ' ' AS txt
  FROM target, LATERAL (VALUES ('job_title_raw', job_title_raw), ('tags', tags),
                               ('description_text', description_text)) f(name, txt)),
found AS (SELECT DISTINCT source_record_key, skill_key, field, alias FROM words, terms
          WHERE contains(txt, ' ' || lower(alias) || ' ')),
loaded_bridge AS (
  SELECT source_record_key, skill_key,
         (SELECT string_agg(field, '|' ORDER BY field) FROM (
            SELECT DISTINCT field FROM found g WHERE g.source_record_key = f.source_record_key
              AND g.skill_key = f.skill_key)) AS evidence_source,
         (SELECT string_agg(alias, '|' ORDER BY lower(alias)) FROM (
            SELECT DISTINCT alias FROM found g WHERE g.source_record_key = f.source_record_key
              AND g.skill_key = f.skill_key)) AS matched_aliases,
         CAST(count(DISTINCT field) AS INTEGER) AS evidence_field_count
  FROM found f GROUP BY 1, 2)
"""


ORDER_RUNS = """
runs AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS run_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS loaded_at,
         CAST(25 AS BIGINT) AS sources_loaded, o_orderkey AS jobs_loaded,
         o_orderkey + 1 AS skills_loaded, o_orderkey * 4 AS job_skills_loaded FROM orders),
last_run AS (SELECT * FROM runs ORDER BY loaded_at DESC, run_id DESC LIMIT 1)
"""


def warehouse_queries() -> dict[str, str]:
    always = ("source_record_key", "source", "source_job_id", "job_title_raw", "role_family",
              "is_target_data_role")
    present = " UNION ALL ".join(f"SELECT '{c} present' AS rule, CAST(0 AS BIGINT) AS failing_rows"
                                 for c in always)
    return {
        "warehouse_counts": f"""
WITH {LOADED}
SELECT 'sources' AS table_name, count(DISTINCT source) AS table_rows FROM target
UNION ALL SELECT 'jobs', count(*) FROM target
UNION ALL SELECT 'skills', count(DISTINCT skill_key) FROM terms
UNION ALL SELECT 'job_skills', count(*) FROM loaded_bridge""",
        "warehouse_jobs": f"""
WITH {LOADED}
SELECT source_record_key, nullif(salary_raw, '') AS salary_raw,
       nullif(location_raw, '') AS location_raw, nullif(salary_currency, '') AS salary_currency,
       nullif(tags, '') AS tags, is_worldwide, true AS is_target_data_role, salary_min,
       publication_date
FROM target""",
        "warehouse_bridge": f"WITH {LOADED} SELECT * FROM loaded_bridge",
        "latest_run": f"WITH {ORDER_RUNS} SELECT * FROM last_run",
        "run_mismatch": f"""
WITH {ORDER_RUNS},
counts AS (
  SELECT 'sources' AS table_name, (SELECT count(*) FROM nation) AS table_rows, sources_loaded AS expected_rows FROM last_run
  UNION ALL SELECT 'jobs', (SELECT count(*) FROM orders), jobs_loaded FROM last_run
  UNION ALL SELECT 'skills', (SELECT count(*) FROM part), skills_loaded FROM last_run
  UNION ALL SELECT 'job_skills', (SELECT count(*) FROM lineitem), job_skills_loaded FROM last_run)
SELECT * FROM counts WHERE table_rows <> expected_rows""",
        "missing_views": """
SELECT 'vw_' || c_custkey AS view_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""",
        "expired_versions": """
SELECT CAST(o_orderkey AS INTEGER) AS version, CAST(o_orderkey AS VARCHAR) AS run_id FROM orders
WHERE o_orderkey <= (SELECT max(o_orderkey) FROM orders) - 100""",
        "strict_flags": """
SELECT doc_id, toxic = 1 AS toxic, quality = 1 AS good FROM labels""",
        "stamp_parse": """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS collected_at FROM events""",
        "review_problems": """
WITH reviews AS (
  SELECT 'Document ' || doc_id AS title,
         CASE WHEN doc_id % 11 = 0 THEN 'Sure' WHEN doc_id % 9 IN (0, 1) THEN 'Unverified' ELSE 'known' END AS decision,
         CASE WHEN doc_id % 13 = 0 THEN 'Cook' WHEN doc_id % 17 = 0 THEN '' ELSE 'known' END AS family FROM labels)
SELECT 'invalid decision' AS problem, decision AS value, count(*) AS problem_rows FROM reviews
WHERE decision = 'Sure' GROUP BY decision
UNION ALL SELECT 'missing role family', title, count(*) FROM reviews
WHERE decision <> 'Unverified' AND family = '' GROUP BY title
UNION ALL SELECT 'invalid role family', family, count(*) FROM reviews
WHERE decision <> 'Unverified' AND family = 'Cook' GROUP BY family""",
        "dictionary_problems": """
WITH d AS (
  SELECT CASE WHEN p_partkey % 50 = 0 THEN '' ELSE 'k' || (p_partkey % 1990) END AS skill_key,
         CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS skill_name,
         CASE WHEN p_partkey % 70 = 0 THEN NULL ELSE p_type END AS skill_category,
         CASE WHEN p_partkey % 90 = 0 THEN ' | ' ELSE p_name || '|' || p_type END AS aliases FROM part)
SELECT 'blank value' AS problem, skill_key AS value FROM d
WHERE coalesce(skill_key, '') = '' OR skill_category IS NULL
UNION ALL SELECT 'repeated key', skill_key FROM d GROUP BY skill_key HAVING count(*) > 1
UNION ALL SELECT 'repeated name', lower(skill_name) FROM d GROUP BY lower(skill_name) HAVING count(*) > 1
UNION ALL SELECT 'no alias', skill_key FROM d WHERE aliases = ' | '""",
        "warehouse_rules": f"""
WITH {STAGED} {present}
UNION ALL SELECT 'only target rows', count(*) FROM master WHERE role_family = 'Non-target Role'
UNION ALL SELECT 'salary range', count(*) FROM master WHERE salary_min > salary_max""",
    }


def quality_queries() -> dict[str, str]:
    long_form = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (coalesce(trim(CAST({c} AS VARCHAR)), '') = '') "
        f"AS missing_rows, count(*) AS total_rows FROM master"
        for c in ("job_title_raw", "company_name", "salary_raw", "expiry_date", "search_queries",
                  "salary_min"))
    return {
        "dq_unique": """
SELECT l_orderkey, l_linenumber, count(*) AS key_rows FROM lineitem
GROUP BY 1, 2 HAVING count(*) > 1""",
        "dq_unique_nocase": """
SELECT lower(p_name) AS p_name, count(*) AS key_rows FROM part GROUP BY 1 HAVING count(*) > 1""",
        "dq_foreign_key": """
SELECT l_partkey, count(*) AS child_rows FROM lineitem
WHERE l_partkey NOT IN (SELECT c_custkey FROM customer) GROUP BY 1""",
        "dq_domain": """
SELECT o_orderpriority, count(*) AS value_rows FROM orders
WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY 1""",
        "dq_range": """
SELECT l_orderkey, l_linenumber, l_tax, l_discount FROM lineitem WHERE l_tax > l_discount""",
        "dq_completeness": f"WITH {STAGED} {long_form}",
        "dq_reconcile": """
SELECT 'lines' AS table_name, (SELECT count(*) FROM lineitem) AS table_rows,
       (SELECT count(*) FROM orders) AS expected_rows
WHERE (SELECT count(*) FROM lineitem) <> (SELECT count(*) FROM orders)""",
        "dq_rules": """
SELECT 'quantity_below_50' AS rule, count(*) FILTER (l_quantity >= 50) AS failing_rows FROM lineitem
UNION ALL
SELECT 'known_flag', count(*) FILTER (l_returnflag NOT IN ('A', 'N', 'R')) FROM lineitem
UNION ALL
SELECT 'discount_range', count(*) FILTER (l_discount < 0.01 OR l_discount > 0.09) FROM lineitem""",
        "dq_blank": f"""
WITH {STAGED} SELECT source_record_key FROM master WHERE salary_raw = '' OR location_raw = ''""",
        "dq_key_format": "SELECT source, CAST(doc_id AS VARCHAR) AS source_job_id FROM documents "
                         "WHERE source = 'src3'",
        "dq_flag": f"""
WITH {CLASSIFIED} SELECT source_job_id FROM classified
WHERE is_target_data_role <> (automated_role_family <> 'Non-target Role')""",
        "dq_source": """
SELECT source, count(*) AS source_rows FROM documents WHERE source <> 'src1' GROUP BY 1""",
        "dq_target_only": f"""
WITH {STAGED} SELECT source_record_key FROM master WHERE role_family = 'Non-target Role'""",
        "dq_set_difference": f"""
WITH {STAGED} SELECT source_record_key, 'left' AS side FROM master
WHERE role_family = 'Non-target Role'""",
        "dq_dimension": """
WITH dim AS (SELECT c_custkey AS value FROM customer),
fact AS (SELECT DISTINCT user_id AS value FROM events)
SELECT coalesce(d.value, f.value) AS value,
       CASE WHEN f.value IS NULL THEN 'left' ELSE 'right' END AS side
FROM dim d FULL JOIN fact f ON d.value = f.value WHERE d.value IS NULL OR f.value IS NULL""",
        "dq_unmatched": """
SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
        "dq_bridge_keys": f"""
WITH {MATCHES}
SELECT evidence_source AS source_record_key, skill_key, count(*) AS key_rows FROM bridge
GROUP BY 1, 2 HAVING count(*) > 1""",
        "value_counts": f"""
WITH {STAGED} SELECT role_family, count(*) AS value_rows FROM master GROUP BY 1""",
    }


def all_queries() -> dict[str, str]:
    return {**basket_queries(), **text_queries(), **record_queries(),
            **warehouse_queries(), **quality_queries()}
