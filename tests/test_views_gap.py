import itertools
import random
from collections import Counter

import pytest

from postmill.plans import gap, reports, views

KNOWN = ["s0", "s1", "unknown"]
JOBS = "source_record_key string, role_family string, company_name string, salary_min double, " \
       "salary_max double, salary_currency string, salary_period string, source string"


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(3)
    keys = [f"s{i}" for i in range(9)]
    jobs = [(f"j{i}", rng.choice(["DA", "DA", "DE"]), rng.choice("abc"), rng.choice([None, 10.0, 20.5]),
             rng.choice([None, 30.0]), rng.choice([None, "USD"]), "year", rng.choice(["x", "y"]))
            for i in range(80)]
    bridge = [(j[0], k) for j in jobs for k in keys[:8] if rng.random() < .35 and j[0] != "j0"]
    return {"jobs": jobs, "bridge": bridge, "keys": keys,
            "j": spark.createDataFrame(jobs, JOBS),
            "s": spark.createDataFrame([(k, k.upper(), "cat") for k in keys],
                                       "skill_key string, skill_name string, skill_category string"),
            "b": spark.createDataFrame(bridge, "source_record_key string, skill_key string")}


def sets(world, role=None):
    roles = {j[0]: j[1] for j in world["jobs"]}
    out = {k: set() for k, r in roles.items() if role in (None, r)}
    for job, skill in world["bridge"]:
        if job in out:
            out[job].add(skill)
    return out


def test_demand(world):
    got = {r.skill_key: (r.job_count, r.job_share_pct)
           for r in views.skill_demand(world["j"], world["s"], world["b"]).collect()}
    want = Counter(k for _, k in world["bridge"])
    assert got == {k: (n, round(100.0 * n / 80, 2)) for k, n in want.items()}
    assert "s8" not in got


def test_cooccurrence_by_brute_force(world):
    got = {(r.skill_1_key, r.skill_2_key): r for r in
           views.skill_cooccurrence(world["j"], world["s"], world["b"]).collect()}
    baskets = sets(world).values()
    single = Counter(s for b in baskets for s in b)
    pairs = Counter(p for b in baskets for p in itertools.combinations(sorted(b), 2))
    assert {k: r.cooccurrence_jobs for k, r in got.items()} == pairs
    for (a, b), n in pairs.items():
        r = got[a, b]
        assert (r.skill_1_jobs, r.skill_2_jobs) == (single[a], single[b])
        assert r.lift == pytest.approx(n * 80 / (single[a] * single[b]), abs=6e-5)
        assert r.jaccard_similarity == pytest.approx(n / (single[a] + single[b] - n), abs=6e-5)


def test_baskets_and_bridge_are_interchangeable(world):
    forms = [views.skill_baskets(world["b"]), views.job_baskets(world["j"], world["b"])]
    for view in (views.skill_demand, views.role_skill_demand, views.skill_cooccurrence,
                 views.role_skill_cooccurrence, reports.market_kpis,
                 lambda j, s, b: gap.skill_priority(j, s, b, KNOWN, "DA"),
                 lambda j, s, b: gap.profile_coverage(j, b, KNOWN, "DA"),
                 lambda j, s, b: gap.marginal_gain(j, s, b, KNOWN)):
        one = sorted(map(tuple, view(world["j"], world["s"], world["b"]).collect()))
        for form in forms:
            assert one == sorted(map(tuple, view(world["j"], world["s"], form).collect()))


def test_gain_over_stored_baskets_shuffles_only_results(spark, world, tmp_path):
    views.job_baskets(world["j"], world["b"]).write.partitionBy("role_family").parquet(f"{tmp_path}/b")
    stored = spark.read.parquet(f"{tmp_path}/b")
    plan = (gap.marginal_gain(world["j"], world["s"], stored, KNOWN, "DA")
            ._jdf.queryExecution().executedPlan().toString())
    assert "Exchange" not in plan[plan.index("Generate explode"):plan.index("FileScan")]
    assert "PartitionFilters: [isnotnull(role_family" in plan


def test_repeated_bridge_rows_do_not_inflate_pairs(world):
    doubled = world["b"].unionByName(world["b"])
    one = sorted(map(tuple, views.skill_cooccurrence(world["j"], world["s"], world["b"]).collect()))
    assert one == sorted(map(tuple, views.skill_cooccurrence(world["j"], world["s"], doubled).collect()))


def test_salary(world):
    got = {r.role_family: r for r in views.salary_by_role(world["j"]).collect()}
    for role, r in got.items():
        use = [j for j in world["jobs"] if j[1] == role and j[5] and (j[3] or j[4])]
        mids = [(j[3] + j[4]) / 2 if j[3] and j[4] else j[3] or j[4] for j in use]
        assert r.salary_job_count == len(use)
        assert r.avg_salary_midpoint == pytest.approx(sum(mids) / len(mids), abs=.006)


def what_if(world, role, known):
    out = {}
    baskets = sets(world, role)
    full = [b for b in baskets.values() if b]
    for skill in sorted({s for b in full for s in b} - set(known)):
        mine = set(known)
        base = [100 * len(b & mine) / len(b) for b in full]
        new = [100 * len(b & (mine | {skill})) / len(b) for b in full]
        out[skill] = (sum(base) / len(base), sum(new) / len(new),
                      sum(x < 50 <= y for x, y in zip(base, new)),
                      sum(len(b & mine) < 3 <= len(b & (mine | {skill})) for b in baskets.values()))
    return out


@pytest.mark.parametrize("known", [KNOWN, [], ["s0", "s1", "s2", "s3"]])
def test_gain_equals_literal_what_if(world, known):
    want = what_if(world, "DA", known)
    got = {r.skill_key: r for r in
           gap.next_skills(world["j"], world["s"], world["b"], known, "DA").collect()}
    assert got.keys() == want.keys()
    for key, (base, new, half, three) in want.items():
        r = got[key]
        assert r.baseline_avg_coverage_pct == pytest.approx(base, abs=.006)
        assert r.new_avg_coverage_pct == pytest.approx(new, abs=.006)
        assert r.marginal_coverage_gain_pct_points == pytest.approx(new - base, abs=.006)
        assert (r.jobs_newly_reaching_50pct, r.jobs_newly_reaching_3_matches) == (half, three)


def test_gain_of_all_roles_holds_gain_of_one(world):
    every = gap.marginal_gain(world["j"], world["s"], world["b"], KNOWN).filter("role_family = 'DE'")
    one = gap.marginal_gain(world["j"], world["s"], world["b"], KNOWN, "DE")
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, one.collect()))


def test_coverage(world):
    r = gap.profile_coverage(world["j"], world["b"], KNOWN, "DA").first()
    baskets = sets(world, "DA")
    shares = [len(b & set(KNOWN)) / len(b) for b in baskets.values() if b]
    assert (r.target_jobs, r.jobs_with_detected_skills) == (len(baskets), len(shares))
    assert r.avg_observed_skill_coverage_pct == pytest.approx(100 * sum(shares) / len(shares), abs=.006)
    assert r.jobs_at_50pct_plus_coverage == sum(s >= .5 for s in shares)


def test_role_without_postings(world):
    r = gap.profile_coverage(world["j"], world["b"], KNOWN, "none").first()
    assert r.target_jobs == 0 and r.avg_observed_skill_coverage_pct is None
    assert r.jobs_with_1_plus_matches_pct is None
    assert gap.next_skills(world["j"], world["s"], world["b"], KNOWN, "none").isEmpty()


def test_priority(world):
    baskets = sets(world, "DA")
    got = {r.skill_key: r for r in
           gap.skill_priority(world["j"], world["s"], world["b"], KNOWN, "DA").collect()}
    count = Counter(s for b in baskets.values() for s in b)
    for key, r in got.items():
        both = {k: sum({k, key} <= b for b in baskets.values()) for k in KNOWN}
        pct = [round(100 * n / count[k], 2) if n else 0 for k, n in both.items()]
        share = round(100 * count[key] / len(baskets), 2)
        score = .8 * share + .2 * sum(pct) / 3
        assert (r.skill_job_count, r.role_job_count) == (count[key], len(baskets))
        assert r.known_skill_connections == sum(n > 0 for n in both.values())
        assert r.summed_pair_support == sum(both.values())
        assert r.priority_score == pytest.approx(score, abs=.011)
        assert r.priority_tier == ("High Priority" if score >= 45 else
                                   "Medium Priority" if score >= 25 else "Lower Priority")
    assert set(got) == set(count) - set(KNOWN)
    assert gap.skill_priority(world["j"], world["s"], world["b"], [], "DA").isEmpty()


def test_reports(world):
    j, s, b = world["j"], world["s"], world["b"]
    k = reports.market_kpis(j, s, b).first()
    assert (k.postings, k.companies, k.skills_tracked, k.relationships) == (80, 3, 9, len(world["bridge"]))
    top = reports.role_top_skills(j, s, b, 2).collect()
    assert len(top) == 4
    assert {r.sample_confidence for r in reports.role_overview(j).collect()} <= {
        "Higher confidence", "Moderate confidence"}
    strong = reports.strong_associations(j, s, b, 10, 3).collect()
    assert all(r.cooccurrence_jobs >= 10 for r in strong) and len(strong) <= 3
    assert [r.job_count for r in reports.top_skills(s, b, 3).collect()] == [
        n for _, n in Counter(x for _, x in world["bridge"]).most_common(3)]
    assert reports.comparable_salaries(j, "USD", "year").count() == 2


def test_views_registered(spark, world):
    names = views.register_views(spark, world["j"], world["s"], world["b"])
    assert all(spark.table(n).count() > 0 for n in names)
