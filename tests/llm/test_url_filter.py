import re

import pytest

from postmill.llm import url_filter as uf

URLS = [None, "", "no-scheme.net/a", "http://", "http://net/", "http://a.net", "http://a.net/", "https://A.NET/x?y#z",
        "http://example.net/en/1", "http://b.example.net/en/", "http://example.net/en", "http://xexample.net/en/",
        "http://example.com/de/1", "http://m.example.com/de/?q", "http://example.com/fr/", "http://some.org/fr/9#t",
        "http://org/fr/", "http://some.org/FR/", "http://ads.bad.org/", "http://bad.org", "http://sbad.org/", "x://y://z.net/",
        "http://a.net?u=/en/", "http://ex#ample.net/", "//ÄÖ.net/", "http://ÄÖ.net/ä", "http://a.net/" + "p" * 5_000]
BLOCK, ALLOW = [("net", "/"), ("example.com", "/de/")], [("example.net", "/en/"), ("org", "/fr/")]
LISTED = [("bad.org", ""), ("example.com", "/fr/")]


def brute(url):
    at = (url or "").find("://")
    rest = url[at + 3:] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)

    def fits(rule):
        return (host == rule[0] or host.endswith("." + rule[0])) and path.startswith(rule[1])

    rules = [(len(h + p), v, h + p) for v, rs in (("block", BLOCK), ("allow", ALLOW)) for h, p in rs if fits((h, p))]
    listed = max((h + p for h, p in LISTED if fits((h, p))), key=len, default=None)
    best = max(rules, default=None)
    return host, path, best and best[2], best[1] if best else "block" if listed else "allow", listed


# Shards of one key take several passes.
@pytest.mark.parametrize("shard_keys, per_pass", [(1 << 20, 8), (1, 1)])
def test_against_brute_force(spark, shard_keys, per_pass):
    rows = [(i if i else None, u, "x", "y", "z") for i, u in enumerate(URLS * 3)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string, rule string, key string")
    tables = [uf.rule_table(spark, x) for x in (BLOCK, ALLOW, [*LISTED, ("", "/"), (None, "/x")])]
    got = uf.filter_urls(pages, *tables, shard_keys, per_pass).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((r[0], *brute(r[1]))) for r in rows)


def test_cascade_is_exact(spark):
    keys = [f"k{i}" for i in range(4_000)]
    listed, universe = keys[::17], keys
    frames = [spark.createDataFrame([(k,) for k in x], "key string") for x in (listed, universe)]
    cascade = uf.build_cascade(*frames)
    assert len(cascade.levels) > 2
    assert [k for k in universe if k in cascade] == listed
    # It is smaller than the list it stands for.
    assert sum(level.bits for level in cascade.levels) / 8 < sum(map(len, listed)) * 2


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string")
    none = uf.rule_table(spark, [])
    assert uf.filter_urls(pages, none, none, none).collect() == []
    one = spark.createDataFrame([(1, "http://a.b/c")], "page_id bigint, url string")
    assert list(map(tuple, uf.filter_urls(one, none, none, none).collect())) == [(1, "a.b", "/c", None, "allow", None)]


def test_jobs_do_not_grow_with_partitions(spark):
    """211 shuffle partitions that stay apart: a handful of jobs for each level."""
    pages = spark.createDataFrame([(i, f"http://h{i % 97}.a{i % 13}.net/p{i}") for i in range(3_000)], "page_id bigint, url string")
    tables = [uf.rule_table(spark, x) for x in (BLOCK, ALLOW, [(f"h{i}.a1.net", "") for i in range(40)])]
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "211")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    context = spark.sparkContext
    context.setJobGroup("cascade", "jobs of the filter")
    try:
        got = uf.filter_urls(pages, *tables).count()
        jobs = len(context.statusTracker().getJobIdsForGroup("cascade"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == 3_000 and jobs < 60
