import random
import re

import pytest

from postmill.functions.matching import STUDY_FIELD_RULE, ContextRule, Skill, skills_from_rows
from postmill.fixed import SKILLS
from postmill.plans import skill_index
from postmill.plans import skills as sk
from postmill.plans.skill_index import extract_skills_joined
from postmill.queries import all_queries
from postmill.session import inline_table

JOB = "source_record_key string, source string, source_job_id string, job_title_raw string, " \
      "company_name string, role_family string, tags string, description_text string, " \
      "publication_date string, job_url string"


def jobs(spark, *texts, title="Role", tags=""):
    rows = [(f"a::{i}", "A", str(i), title, "C", "F", tags, x, "2026-01-01", "u")
            for i, x in enumerate(texts)]
    return spark.createDataFrame(rows, JOB)


def found(spark, text, **kw):
    return {r.skill_key for r in sk.extract_skills(jobs(spark, text, **kw)).collect()}


@pytest.mark.parametrize("text, keys", [
    ("Read https://docs.example.com/api/python/ first", set()),
    ("Build and maintain REST APIs for partners", {"apis"}),
    ("Bachelor's degree in Data Science, Statistics, or Maths", set()),
    ("Perform statistical analysis and hypothesis testing", {"statistics"}),
    ("Degree in statistics. " + "x " * 100 + "We use statistics", set()),
    ("We use statistics daily. " + "x " * 100 + "Degree in statistics", {"statistics"}),
    ("degree in statistics, with statistical methods", {"statistics"}),
    ("Own A/B testing", {"ab_testing"}), ("experimentation initiatives", set()),
    ("NoSQL and MySQL2", set()), ("T-SQL", {"sql"}), ("power   BI", {"power_bi"}),
    ("Kuberneteſ and EXCEL", {"kubernetes", "excel"}), ("CI/CD,Docker", {"ci_cd", "docker"}),
    ("sql_server", set()), ("Sparks fly", set()), (None, set())])
def test_what_counts(spark, text, keys):
    assert found(spark, text) == keys


def test_evidence(spark):
    row = sk.extract_skills(jobs(spark, "sql, T-SQL and structured query language",
                                 title="SQL Developer", tags="x|sql")).collect()
    assert [tuple(r) for r in row] == [
        ("a::0", "sql", "description_text|job_title_raw|tags",
         "SQL|Structured Query Language|T-SQL", 3)]


def brute_force(texts, skills, rule):
    """The definition, one text and one alias at a time."""
    out = set()
    for key, text in texts:
        for skill in skills:
            aliases = set()
            for alias in skill.aliases:
                body = r"\s+".join(re.escape(w) for w in alias.split(" "))
                m = re.search(rf"(?<![A-Za-z0-9_]){body}(?![A-Za-z0-9_])", text, re.I)
                if not m:
                    continue
                if rule and skill.key == rule.skill:
                    around = text[max(0, m.start() - rule.chars):m.end() + rule.chars].lower()
                    if any(w in around for w in rule.when_terms) and not any(
                            w in around for w in rule.unless_terms):
                        continue
                aliases.add(alias)
            if aliases:
                out.add((key, skill.key, "|".join(sorted(aliases, key=str.casefold))))
    return out


@pytest.fixture(scope="module")
def noisy(spark):
    rng = random.Random(7)
    words = ("sql T-SQL python excel Power BI powerbi statistics degree in bachelor statistical "
             "methods machine learning A/B testing ci/cd été 日本 data-quality İx , . ( ) _ "
             "hypothesis testing c++ r language").split()
    return [(f"a::{i}", " ".join(rng.choice(words) + rng.choice(["", "", ",", "_", "s", "é"])
                                 for _ in range(rng.randint(1, 120)))) for i in range(150)]


EXTRA = sk.DEFAULT_SKILLS + (Skill("odd", "Odd", "X", ("日本", "C++", "été", "++", "Data-Quality")),)


def test_matches_brute_force(spark, noisy):
    frame = jobs(spark, *[t for _, t in noisy], title="")
    got = {(r.source_record_key, r.skill_key, r.matched_aliases)
           for r in sk.extract_skills(frame, EXTRA).collect()}
    assert got == brute_force(noisy, EXTRA, STUDY_FIELD_RULE) and len(got) > 500


def test_dictionary_table_gives_the_same(spark, noisy):
    frame = jobs(spark, *[t for _, t in noisy], title="sql lead", tags="excel|C++")
    rows = [(s.key, s.name, s.category, "| ".join(s.aliases)) for s in EXTRA]
    table = inline_table(spark, ("skill_key", "skill_name", "skill_category", "aliases"), rows)
    one = sorted(map(tuple, sk.extract_skills(frame, EXTRA).collect()))
    for buckets in (1 << 20, 64):  # with 64 nearly every token is kept
        found = extract_skills_joined(frame, table, buckets=buckets)
        assert sorted(map(tuple, found.collect())) == one


def test_five_thousand_aliases(spark):
    draw = random.Random(11)
    pieces = ["data", "c++", "c", "node.js", "été", "日本", "a/b", "#", "x_1", "web", "für", ".net", "r&d", "++"]
    pieces += [f"w{i}" for i in range(150)]
    aliases = {" ".join(draw.choice(pieces) for _ in range(draw.randrange(1, 4))) for _ in range(9_000)}
    aliases = sorted(aliases | {a + draw.choice(["", "-", ".", "/x"]) for a in sorted(aliases)[::20]})
    rows, at = [], 0
    while at < len(aliases):
        n = draw.randrange(1, 6)
        rows.append((f"k{at}", f"Skill {at}", "C", " | ".join(aliases[at:at + n])))
        at += n
    assert len(aliases) >= 5_000
    texts = ["".join(draw.choice(pieces) + draw.choice([" ", "  ", "", "-", ", ", "\n", "/"]) for _ in range(60))
             for _ in range(60)]
    frame = jobs(spark, *texts, title="node.js lead", tags="data web|c++")
    table = inline_table(spark, ("skill_key", "skill_name", "skill_category", "aliases"), rows)
    want = sorted(map(tuple, sk.extract_skills(frame, skills_from_rows(rows), ()).collect()))
    got = sorted(map(tuple, extract_skills_joined(frame, table, ()).collect()))
    assert got == want and len(got) > 2_000


def test_index_reads_the_texts_once_and_ships_no_text(spark, noisy):
    frame = jobs(spark, *[t for _, t in noisy], title="")
    aliases = skill_index.alias_table(inline_table(
        spark, ("skill_key", "aliases"), [(s.key, "|".join(s.aliases)) for s in EXTRA]))
    index = skill_index.token_index(frame, aliases, (STUDY_FIELD_RULE,), ("title", "description_text")[1:])
    plan = index._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.split("Subquery")[0] and index.columns == [
        "source_record_key", "field", "token", "at", "spaced", "may_begin", "may_end", "skill_key", "alias"]


def test_index_rows_have_neighbours_only(spark):
    """No row carries the tokens of its whole text, and no token is kept that stands alone."""
    table = inline_table(spark, ("skill_key", "aliases"), [("a", "one two. three|x"), ("b", "été")])
    frame = jobs(spark, "one . two. three x . é t é t", "x", "two one three . é", title="")
    index = skill_index.token_index(frame, skill_index.alias_table(table), (), ("description_text",))
    plan = index._jdf.queryExecution().optimizedPlan().toString()
    assert not any(line.count("all#") for line in plan.splitlines() if line.lstrip(" :+-").startswith("Project [source_record_key")
                   and "f#" in line)
    got = sorted((r.source_record_key, r.at, r.token) for r in index.collect())
    assert got == [("a::0", 2, "two"), ("a::0", 3, "."), ("a::0", 4, "three"), ("a::0", 5, "x"), ("a::0", 7, "é"),
                   ("a::0", 8, "t"), ("a::0", 9, "é"), ("a::0", 10, "t"), ("a::1", 0, "x")]


def test_surroundings_are_cut_out_once(spark):
    """However many terms a context rule has, a text is split once an alias."""
    rule = ContextRule("sql", tuple(f"when{i}" for i in range(20)), tuple(f"unless{i}" for i in range(20)))
    plan = sk.extract_skills(jobs(spark, "sql when7"), rules=(rule,), fields=("description_text",))
    assert plan.collect() == []
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("split(") <= 4


def test_plan_has_no_shuffle(spark):
    plan = sk.extract_skills(jobs(spark, "sql"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_dictionary_size():
    assert len(SKILLS) == 54 and sum(len(s.aliases) for s in sk.DEFAULT_SKILLS) == 128
    assert len({s.name.lower() for s in sk.DEFAULT_SKILLS}) == 54


@pytest.fixture(scope="module")
def world(spark):
    frame = jobs(spark, "SQL and python dashboards", "machine learning with python", "nothing here",
                 "Dashboard " + "y " * 200)
    return frame, sk.skill_dimension(spark), sk.extract_skills(frame)


def test_exclusion(spark, world):
    _, _, bridge = world
    human = sk.check_exclusions(sk.clean_exclusions(spark.createDataFrame(
        [("a::1 ", "machine_learning", "exclude", "no"), ("a::9", "sql", "exclude", "absent")],
        "source_record_key string, skill_key string, override_action string, reason string")))
    kept = sk.apply_exclusions(bridge, human)
    assert kept.count() == bridge.count() - 1 and sk.excluded_count(bridge, human).first()[0] == 1
    assert kept.filter("skill_key = 'machine_learning'").isEmpty()


def test_audit(spark, world):
    audit = sk.skill_audit(*world).orderBy(*sk.audit_order()).collect()
    assert [(r.source_job_id, r.detected_skill_count, r.detected_skills) for r in audit] == [
        ("2", 0, ""), ("3", 1, "Dashboarding"), ("1", 2, "Machine Learning|Python"),
        ("0", 3, "Dashboarding|Python|SQL")]
    assert sk.jobs_without_skills(sk.skill_audit(*world)).count() == 1
    assert tuple(sk.extraction_summary(world[0], world[2]).first()) == (4, 6, 3, 75.0, 1.5)


def test_audit_sample(spark, world):
    rows = sk.skill_audit_sample(*world, top=2).collect()
    assert tuple(rows[0].asDict()) == sk.AUDIT_COLUMNS
    kinds = sorted((r.audit_type, r.source_job_id, r.skill_key) for r in rows)
    assert kinds == [("High Detected Skill Count", "0", ""), ("High Detected Skill Count", "1", ""),
                     ("No Skills Detected", "2", ""),
                     ("Potentially Ambiguous Match", "0", "dashboarding"),
                     ("Potentially Ambiguous Match", "1", "machine_learning"),
                     ("Potentially Ambiguous Match", "3", "dashboarding")]
    long = next(r for r in rows if r.source_job_id == "3")
    assert long.evidence_excerpt == ("Dashboard " + "y " * 200)[:len("dashboard") + 180].strip()


def test_excerpt_prefers_title_and_ignores_word_ends(spark):
    frame = jobs(spark, "x " * 100 + "reSQLed " + "z " * 200, title="")
    bridge = spark.createDataFrame([("a::0", "sql", "d", "Nope| SQL", 1)],
                                   "source_record_key string, skill_key string, evidence_source string, "
                                   "matched_aliases string, evidence_field_count int")
    text = sk.with_excerpt(frame.join(bridge, "source_record_key")).first().evidence_excerpt
    whole = "x " * 100 + "reSQLed " + "z " * 200
    at = whole.index("SQL")
    assert text == whole[at - 120:at + 3 + 180].strip()


def test_bridge_keys_match_each_text_once(spark, tmp_path):
    """The two checks, each of two passes, read a bridge that is there already."""
    rows = [(i, "that the license", "en", "src1") for i in range(3)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(
        f"{tmp_path}/documents.parquet")
    found = all_queries()["dq_bridge_keys"](spark, str(tmp_path))
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [
        ("description_text|job_title_raw", "license_word", 3), ("description_text|job_title_raw", "that_word", 3)]
