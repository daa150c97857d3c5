"""The stages one by one, each against what its operator (tested on its own) decides."""

import random
import re

import duckdb
import pytest

import corpus_pipeline as pipeline
from llm_tables import docs_table, words
from postmill.llm import decontaminate

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.cache()]
    for _, stage in pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def ids(frame):
    return sorted(r.doc_id for r in frame.collect())


def test_columns_and_subsets(steps):
    assert [n for n, _ in pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontamination", "mixing"]
    for before, after in zip(steps[:4], steps[1:5]):
        assert after.columns == steps[0].columns
        assert set(after.collect()) <= set(before.collect())
    assert ids(steps[5]) == ids(steps[4])


def test_clean_documents_stay(steps):
    con = duckdb.connect()
    bad = {r[0] for r in con.sql(f"select doc_id from '{SF}/labels.parquet' where quality = 0").fetchall()}
    good = {r[0] for r in con.sql(f"select doc_id from '{SF}/labels.parquet' where quality = 1").fetchall()}
    kept = set(ids(steps[1]))
    assert len(good - kept) <= 0.02 * len(good) and len(bad & kept) <= 0.1 * len(bad)


def test_exact_stage(steps):
    by_text = {}
    for r in steps[1].collect():
        by_text[r.text] = max(r.doc_id, by_text.get(r.text, r.doc_id))
    assert ids(steps[2]) == sorted(by_text.values())


def shingle_set(text):
    """Five-word shingles of the lower-cased text; a shorter text is one, one without words none."""
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups_of(rows):
    """Smallest id of each row's group under Jaccard similarity of 0.8 or more, every pair tried."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if (both * 5 >= (len(a) + len(b) - both) * 4) if a or b else True:
                root[find(i)] = find(j)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            low[find(i)] = min(doc_id, low.get(find(i), doc_id))
    return [low.get(find(i)) for i in range(len(rows))]


def test_near_stage(steps):
    rows = sorted((r.doc_id, r.text) for r in steps[2].collect())
    assert ids(steps[3]) == [i for (i, _), low in zip(rows, groups_of(rows)) if i == low]


def test_near_stage_tells_rows_apart(spark):
    """Ids that repeat or are null: what becomes of one row says nothing of others with its id."""
    draw = random.Random(11)
    a, b, c, d, e, f, g = (words(draw, 80, 4_000) for _ in range(7))
    rows = [(3, a), (5, a + " tail"), (5, b),  # 5 is a near copy, and a document of its own
            (8, c), (None, c + " tail"), (None, d),  # so is one of the rows without an id
            (None, e), (None, e + " tail"), (None, e + " end"), (9, f), (9, f + " tail"), (10, g), (10, g)]
    near = pipeline.drop_near_copies(spark, docs_table(spark, [(*r, "en", "a") for r in rows]), SF)
    got = [(r.doc_id, r.text) for r in near.collect()]
    assert sorted(r for r in got if r[0] not in (None, 9)) == [(3, a), (5, b), (8, c), (10, g), (10, g)]
    assert [i for i, _ in got].count(9) == 1
    alone = [t for i, t in got if i is None]
    assert len(alone) == 2 and d in alone and set(got) <= set(rows)


def test_near_stage_leaves_no_near_copy(spark):
    """Many groups with repeated and null ids: each keeps one text, with the smallest id there is."""
    draw, rows = random.Random(12), []
    for _ in range(60):
        text = words(draw, draw.choice((1, 6, 60, 200)), 4_000)
        for i in range(draw.choice((1, 2, 4))):
            rows.append((draw.choice((None, *range(40))), text + " more" * i))
    near = pipeline.drop_near_copies(spark, docs_table(spark, [(*r, "en", "a") for r in rows]), SF)
    got = {(r.doc_id, r.text) for r in near.collect()}
    ids, group = {}, {}
    for k, (i, t) in zip(groups_of([(n, t) for n, (_, t) in enumerate(rows)]), rows):
        group[t] = k
        ids.setdefault(k, set()).add(i)
    want = [(k, min((i for i in own if i is not None), default=None)) for k, own in ids.items()]
    assert sorted(((group[t], i) for i, t in got), key=repr) == sorted(want, key=repr)


def test_messy_rows_through_the_stages(spark, messy):
    """Nulls, empty and long texts, ties, repeated rows, clashing columns: rows come out whole."""
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    exact = pipeline.drop_copies(spark, messy, SF)
    keep = {}
    for i, t in rows:
        if i is not None:
            keep[t or ""] = max(i, keep.get(t or "", i))
    # A row without an id stays as one where no row of its text has an id.
    alone = [t for i, t in rows if i is None and (t or "") not in keep]
    got = exact.collect()
    kept_ids = sorted(r.doc_id for r in got if r.doc_id is not None)
    assert kept_ids == sorted(i for i, t in rows if i in set(keep.values()))
    assert bool(alone) == any(r.doc_id is None for r in got)
    near = pipeline.drop_near_copies(spark, messy, SF)
    low = groups_of(rows)
    assert sorted(r.doc_id for r in near.collect() if r.doc_id is not None) == sorted(
        i for (i, _), x in zip(rows, low) if i is not None and i == x)
    for stage in (pipeline.drop_low_quality, pipeline.drop_contaminated):
        out = stage(spark, messy, SF)
        assert out.columns == messy.columns and {r.text for r in out.collect()} <= {t for _, t in rows}
    assert pipeline.mix_sources(spark, messy, SF).count() == len(rows)


def test_decontamination_stage(spark, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {i: decontaminate.folded(t).tobytes() for i, t in items}
    leaked = {r.doc_id for r in steps[3].collect()
              if any(t in decontaminate.folded(r.text).tobytes() for t in held.values())}
    assert set(ids(steps[3])) - set(ids(steps[4])) == leaked


def test_run_and_empty(spark, steps):
    assert sorted(map(repr, pipeline.run(spark, SF).collect())) == sorted(map(repr, steps[5].collect()))
    none = steps[0].filter("false")
    for _, stage in pipeline.STAGES:
        none = stage(spark, none, SF)
    assert none.collect() == []
