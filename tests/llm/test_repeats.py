import random

import numpy as np
import pytest

from postmill.llm import repeats, substring_dedup, suffix_dedup
from llm_tables import docs_table, messy_rows, words


def order(i):
    return repeats.NO_ID if i is None else i


def brute_bytes(rows, length=50):
    first = {}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - length + 1):
            w = raw[p:p + length]
            first[w] = min(first.get(w, repeats.NO_ID), order(i))
    out = []
    for i, t, *_ in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), dtype=bool)
        for p in range(len(raw) - length + 1):
            if first[raw[p:p + length]] < order(i):
                gone[p:p + length] = True
        out.append((i, len(raw), repeats.true_runs(gone), np.frombuffer(raw, np.uint8)[~gone].tobytes()))
    return sorted(out, key=repr)


def brute_words(rows, n=20):
    first = {}
    for i, t, *_ in rows:
        parts = (t or "").encode().split()
        for p in range(len(parts) - n + 1):
            w = tuple(parts[p:p + n])
            first[w] = min(first.get(w, (repeats.NO_ID, 1 << 40)), (order(i), p))
    out = []
    for i, t, *_ in rows:
        parts = (t or "").encode().split()
        gone = np.zeros(len(parts), dtype=bool)
        for p in range(len(parts) - n + 1):
            if first[tuple(parts[p:p + n])] < (order(i), p):
                gone[p:p + n] = True
        out.append((i, len(parts), repeats.true_runs(gone), b" ".join(w for w, g in zip(parts, gone) if not g)))
    return sorted(out, key=repr)


def passages(seed, docs=60):
    """Documents of shared passages cut at random places, between words of their own."""
    draw = random.Random(seed)
    shared = [words(draw, 90, 60) for _ in range(5)] + ["the of and " * 30]
    rows = []
    for i in range(docs):
        parts = []
        for _ in range(draw.randrange(1, 5)):
            parts.append(words(draw, draw.randrange(0, 30), 60))
            passage = draw.choice(shared)
            a = draw.randrange(len(passage) - 100)
            parts.append(passage[a:a + draw.randrange(20, 400)])
        rows.append((draw.randrange(10 ** 6), " ".join(parts), "en", "a"))
    return rows


OPERATORS = [(suffix_dedup, brute_bytes), (substring_dedup, brute_words)]


@pytest.mark.parametrize("operator, brute", OPERATORS)
@pytest.mark.parametrize("group_bytes", [8 << 20, 3_000])
def test_messy_tables(messy, operator, brute, group_bytes):
    got = operator.remove_repeats(messy, group_bytes=group_bytes)
    assert sorted(((r[0], r[1], r.spans, bytes(r.kept)) for r in got.collect()), key=repr) == brute(messy_rows())


@pytest.mark.parametrize("operator, brute", OPERATORS)
@pytest.mark.parametrize("hot", [2_000, 4, 1])
def test_passages_with_hot_anchors(spark, operator, brute, hot, monkeypatch):
    # The bound goes to the tasks with the function that reads it.
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = passages(hot)
    got = operator.remove_repeats(docs_table(spark, rows), group_bytes=4_000)
    assert sorted(((r[0], r[1], r.spans, bytes(r.kept)) for r in got.collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("hot", [2_000, 1])
@pytest.mark.parametrize("rule", [repeats.Rule(50, 24, False, False), repeats.Rule(20, 8, True, True)])
def test_steps_by_hand(rule, hot, monkeypatch):
    """The five steps without Spark, so that the bound for hot anchors surely applies."""
    import pyarrow as pa
    monkeypatch.setattr(repeats, "HOT", hot)
    rows, parts = passages(77), 3
    groups = [pa.table({"part": [g] * len(rows[g::parts]), "doc_id": [r[0] for r in rows[g::parts]],
                        "text": [r[1] for r in rows[g::parts]]}) for g in range(parts)]
    cuts = repeats.splitters_of([r[1] for r in rows[:20]], rule, parts)
    assert len(cuts) == parts - 1

    def deal(tables, key):
        whole = pa.concat_tables(tables)
        keys = np.array(whole.column(key).to_pylist())
        return {k: whole.filter(pa.array(keys == k)) for k in set(keys.tolist())}

    offered = deal([repeats.offer(g, rule, parts) for g in groups], "bucket")
    matched = deal([repeats.match(t) for t in offered.values()], "part")
    context = deal([repeats.contexts(g, matched[i], rule, cuts) for i, g in enumerate(groups) if i in matched], "range")
    found = deal([repeats.factors(t, rule) for t in context.values()], "part")
    got = []
    for i, table in enumerate(groups):
        group = repeats.Group(table, rule)
        gone = repeats.covered(group, found[i].column("payload").to_pylist() if i in found else [])
        got += [(int(d), int(n), repeats.true_runs(gone[s:s + n])) for d, s, n in zip(group.ids, group.starts, group.lengths)]
    want = (brute_words if rule.words else brute_bytes)(rows)
    assert sorted(got, key=repr) == sorted((w[:3] for w in want), key=repr)


def test_text_crosses_the_network_once(spark):
    frame = suffix_dedup.remove_repeats(docs_table(spark, passages(1)), group_bytes=4_000)
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("ReusedExchange") == 2


def test_multikey_order():
    draw = np.random.default_rng(3)
    rows = draw.integers(0, 3, (500, 6))
    by, rank = repeats.multikey_order(lambda level, which: rows[which, level], 500, 6)
    assert (rows[by] == rows[np.lexsort(rows.T[::-1])]).all()
    same = (rows[by][1:] == rows[by][:-1]).all(axis=1)
    assert ((rank[1:] == rank[:-1]) == same).all()


@pytest.mark.parametrize("operator", [suffix_dedup, substring_dedup])
def test_empty(empty, operator):
    assert operator.remove_repeats(empty).collect() == []


@pytest.mark.parametrize("ranges", [2, 50, 5_000])
def test_splitters_never_vanish(ranges):
    draw = random.Random(3)
    texts = [words(draw, 200) for _ in range(6)]
    rule = repeats.Rule(20, 8, True, True)
    cuts = repeats.splitters_of(texts, rule, ranges)
    assert cuts == sorted(set(cuts)) and 1 <= len(cuts) < ranges
    if ranges == 5_000:  # more ranges than leads: every lead is a cut
        assert len(cuts) > 50
    hot = repeats.splitters_of([texts[0]] * 40 + texts[1:], rule, ranges)
    assert hot
    assert repeats.splitters_of([], rule, ranges) == repeats.splitters_of(["a"], rule, ranges) == []
