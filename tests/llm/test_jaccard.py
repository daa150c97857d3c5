import random
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from postmill.llm import common, components, jaccard, simhash
from llm_tables import docs_table, messy_rows, words


def shingles(text):
    parts = (text or "").lower().encode().split()
    return {tuple(parts[i:i + 5]) for i in range(max(1, len(parts) - 4))} if parts else set()


def brute(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    ids = {}
    for i, r in enumerate(rows):
        ids.setdefault(find(i), []).append(r[0])
    return sorted(((r[0], min((x for x in ids[find(i)] if x is not None), default=None)) for i, r in enumerate(rows)), key=repr)


def edited_rows(seed):
    """Copies with so many edits that similarities lie on both sides of 0.8, and a chain."""
    draw, rows = random.Random(seed), []
    for base in range(40):
        text = words(draw, draw.choice((4, 5, 9, 60, 150, 400)), 4_000)
        rows.append((100 * base, text, "en", "a"))
        for i in range(1, draw.choice((2, 3, 12))):
            parts = text.split()
            for _ in range(max(1, len(parts) * draw.randrange(6) // 100)):
                parts[draw.randrange(len(parts))] = f"new{draw.randrange(9_999)}"
            if draw.randrange(3) == 0:
                parts += words(draw, len(parts) // 5, 4_000).split()
            rows.append((100 * base + i, " ".join(parts).title(), "en", "a"))
            if base % 2:
                text = rows[-1][1]
    return rows


def got(frame):
    return sorted(map(tuple, jaccard.near_copies(frame).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = edited_rows(seed)
    want = brute(rows)
    assert 40 < len({w[1] for w in want}) < len(rows)
    assert got(docs_table(spark, rows)) == want


def test_messy_rows_and_empty(messy, empty):
    assert got(messy) == brute(messy_rows())
    assert got(empty) == []


def test_stage_drops_copies_beyond_four_bits(spark):
    rows = edited_rows(3)
    kept = sorted(r.doc_id for r in pipeline.drop_near_copies(spark, docs_table(spark, rows), "").collect())
    assert kept == sorted(i for i, c in brute(rows) if i == c)
    near = dict(brute(rows))
    prints = {i: simhash.fingerprint(t) for i, t, *_ in rows}
    assert any(i != c and ((prints[i] ^ prints[c]) & (1 << 64) - 1).bit_count() > 4 for i, c in near.items())


def test_stage_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").dropDuplicates(["text"])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    assert sum(i != c for i, c in want) >= 5
    assert got(docs.filter(docs.doc_id.isin([i for i, _ in rows]))) == want


def test_parities_are_a_bound():
    draw = np.random.default_rng(5)
    for n, m, both in ((1, 1, 0), (5, 4, 4), (40, 300, 30), (700, 600, 590), (3_000, 2_900, 2_000)):
        pool = draw.integers(0, 1 << 63, n + m - both).astype(np.uint64)
        one, two = pool[:n], pool[n - both:]
        apart = jaccard.parities_apart(jaccard.parities(one), jaccard.parities(two))
        assert apart <= n + m - 2 * both and (apart > (n + m - 2 * both) // 5)
        short = [jaccard.brief(jaccard.parities(s)).view(np.uint8) for s in (one, two)]
        assert jaccard.parities_apart(*short) <= n + m - 2 * both
    assert jaccard.parities_apart(jaccard.parities(one), jaccard.parities(one)) == 0


@pytest.mark.parametrize("n", [31, 63, 127, 511])
def test_briefs_of_neighbouring_sizes_are_a_bound(n):
    pool = np.random.default_rng(n).integers(0, 1 << 63, n + 1).astype(np.uint64)
    one, two = (jaccard.brief(jaccard.parities(s)).view(np.uint8) for s in (pool[:n], pool))
    assert jaccard.parities_apart(one, two) == 1


@pytest.mark.parametrize("rounds", [0, 3])
def test_neighbouring_sizes_in_every_round(spark, monkeypatch, rounds):
    """Near copies on both sides of a power of two, with and without rounds before all pairs."""
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    draw, rows = random.Random(8), []
    for i, n in enumerate((34, 35, 66, 67, 130, 131)):
        text = words(draw, n, 4_000)
        rows += [(10 * i, text, "en", "a"), (10 * i + 1, text + " one", "en", "a"), (10 * i + 2, text + " two more", "en", "a")]
    assert len({c for _, c in brute(rows)}) == 6
    assert got(docs_table(spark, rows)) == brute(rows)


def test_stage_searches_by_fingerprints(spark, monkeypatch):
    """The stage takes its first pairs from SimHash; what lies beyond its radius is found too."""
    rows, asked = edited_rows(4), []
    search = simhash.near_duplicates
    monkeypatch.setattr(simhash, "near_duplicates", lambda docs, **k: asked.append(k) or search(docs, **k))
    kept = sorted(r.doc_id for r in pipeline.drop_near_copies(spark, docs_table(spark, rows), "").collect())
    assert asked == [{"words": 5}]
    assert kept == sorted(i for i, c in brute(rows) if i == c)


def test_wrong_classes_change_nothing(spark):
    rows = edited_rows(5)
    frame = docs_table(spark, rows)
    classes = spark.createDataFrame([(i, i % 3) for i, *_ in rows] + [(0, 1), (None, 2)], "doc_id bigint, component_id bigint")
    assert sorted(map(tuple, jaccard.near_copies(frame, classes=classes).collect()), key=repr) == brute(rows)


def test_large_group_makes_few_pairs(spark, monkeypatch):
    """200 copies with one or two edits: most pairs are similar, and few are compared."""
    draw, rows, compared = random.Random(6), [], []
    text = words(draw, 150, 4_000).split()
    for i in range(200):
        parts = list(text)
        for _ in range(1 + i % 2):
            parts[draw.randrange(len(parts))] = f"new{draw.randrange(9_999)}"
        rows.append((i, " ".join(parts), "en", "a"))
    verified = jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, *a: compared.append(pairs.count()) or verified(pairs, *a))
    assert got(docs_table(spark, rows)) == brute(rows)
    assert sum(compared) < 4 * len(rows)


def test_written_leaves_no_shuffle_files(spark):
    """The disk of one query is free before the next begins."""
    folders = [Path(d.getPath()) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in folders for f in d.glob("*/shuffle_*.data")}
    before, setting = files(), spark.conf.get(common.CLEANUP)
    out = common.written(spark.range(1_000).groupBy((F.col("id") % 7).alias("k")).count(), "shuffled")
    end = time.time() + 20
    while files() - before and time.time() < end:  # files go in the background
        time.sleep(0.2)
    assert not files() - before
    assert spark.conf.get(common.CLEANUP) == setting and sorted(map(tuple, out.collect()))[0] == (0, 143)


def test_shingles_of_one_set_alone_are_dropped_first(spark, monkeypatch):
    """Counting ships the shingle alone; places and sets follow for shared ones only."""
    draw, seen = random.Random(9), {}
    rows = [(i, words(draw, 100, 100_000), "en", "a") for i in range(60)]
    rows.append((60, rows[0][1] + " and more", "en", "a"))
    write = jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df, name: seen.setdefault(name, write(df, name)))
    assert got(docs_table(spark, rows)) == brute(rows)
    prefix = jaccard.prefix_length(98)
    assert seen["several"].columns == ["one"] and 0 < seen["several"].count() <= prefix
    assert seen["often"].count() == 2 * seen["several"].count()


def test_components_run_only_their_writes(spark, monkeypatch):
    """No job beside the writes says whether a round changed anything."""
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("rounds"))
    write, within = components.written, []

    def counted(df, name):
        start = jobs()
        out = write(df, name)
        within.append(jobs() - start)
        return out

    monkeypatch.setattr(components, "written", counted)
    edges = [(i, i + 1) for i in range(20)] + [(50, 51), (7, 7), (51, 50)]
    frame = spark.createDataFrame(edges, "a bigint, b bigint")
    spark.sparkContext.setJobGroup("rounds", "rounds")
    try:
        found = components.components(frame)
        assert len(within) > 2 and jobs() == sum(within)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r.node: r.root for r in found.collect()} == {i: 0 for i in range(21)} | {50: 50, 51: 50}
    assert components.components(frame.filter("false")).collect() == []
