import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from llm_tables import docs_table, messy_rows, words
from postmill.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, most):
    docs = [(i, cut(t)) for i, t, *_ in rows]
    docs = [(i, t) for i, t in docs if t]
    n_docs, n_terms = len(docs), sum(len(t) for _, t in docs)
    df = Counter(t for _, terms in docs for t in set(terms))
    counts = [(i, len(t), Counter(t)) for i, t in docs]
    out = []
    for item, text in items:
        found = []
        for i, n, tf in counts:
            m = 75 + (25 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * (1_000_000_000 * tf[t] // (1000 * tf[t] + 12 * m)) for t in cut(text) if t in tf)
            if score > 0:
                found.append((-score, i is None, i if i is not None else 0, i))
        out += [(item, k + 1, f[3], -f[0]) for k, f in enumerate(sorted(found, key=lambda f: f[:3])[:most])]
    return sorted(out, key=repr)


def items_table(spark, items):
    return spark.createDataFrame([(*x, "x", "x") for x in items], "item_id bigint, text string, score string, number string")


def some_items(draw):
    items = [(i, " ".join(f"w{int(draw.paretovariate(0.7)) % 400}x" for _ in range(draw.randrange(1, 40)))) for i in range(25)]
    return items + [(90, None), (91, ""), (92, "?! --"), (93, "nowhere"), (94, "same SAME same w1x"), (95, "ÄÖ 日本語 ßé a"),
                    (96, items[0][1]), (0, items[1][1]), (None, "w3x w3x w4x")]


# Small shards, samples and blocks make many of each.
@pytest.mark.parametrize("shard, sample, block", [(1 << 20, 2_000, 2_000), (40, 25, 2_000), (200, 0, 7)])
def test_against_brute_force(spark, messy, shard, sample, block):
    items = some_items(random.Random(3))
    got = lexical.search(messy, items_table(spark, items), 20, block, 2_000_000, shard, sample)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(messy_rows(), items, 20)


def test_skewed_words_and_ties(spark):
    draw = random.Random(8)
    rows = [(i, " ".join(f"w{int(draw.paretovariate(0.6)) % 300}x" for _ in range(draw.randrange(1, 120))), "en", "a") for i in range(600)]
    rows += [(1000 + i, rows[5][1], "en", "a") for i in range(60)]  # more equal scores than results
    items = some_items(draw) + [(300, rows[5][1])]
    got = lexical.search(docs_table(spark, rows).repartition(5), items_table(spark, items), 10, shard_postings=500, sample_rows=50)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, items, 10)


def test_empty_tables(spark, messy, empty):
    items = items_table(spark, [(1, "w1x")])
    assert lexical.search(empty, items).collect() == []
    assert lexical.search(messy, items_table(spark, [])).collect() == []


def test_pair_bounds_hold_and_are_tighter():
    draw = random.Random(1)
    n = np.array([draw.randrange(3, 30) for _ in range(200)])
    held = [sorted(draw.sample(range(6), draw.randrange(1, 4))) for _ in n]
    sizes, term = np.array([len(h) for h in held]), np.concatenate(held)
    tf = np.array([draw.randrange(1, 4) for _ in term])
    weight = np.array([900, 800, 700, 600, 500, 400])
    pairs = np.array([(0, 1), (2, 3), (4, 5)])
    shard = lexical.Shard(n, sizes, term, tf, weight, 200, int(n.sum()), pairs)
    terms, times = np.arange(6), np.array([2, 1, 1, 1, 1, 3])
    impact = np.zeros((200, 6), dtype=int)
    for t in range(6):
        docs, of = shard.postings(t)
        impact[docs, t] = of
    bounds = shard.bounds(terms, times)
    alone = np.cumsum([int(shard.largest[t]) * times[t] for t in range(6)])
    for k in range(1, 7):
        most = (impact[:, :k] * times[:k]).sum(axis=1).max()
        assert most <= bounds[k] <= alone[k - 1]
    assert bounds[6] < alone[5]
    score = (impact * times).sum(axis=1)
    for least in (1, int(np.median(score)), int(score.max()), int(score.max()) + 1):
        docs, got = shard.search(terms, times, least)
        assert dict(zip(docs.tolist(), got.tolist())) == {d: s for d, s in enumerate(score.tolist()) if s >= least}


def test_terms_are_those_of_the_pattern():
    draw = random.Random(6)
    for _ in range(300):
        text = "".join(chr(draw.choice([draw.randrange(1, 128), draw.randrange(128, 0xD800), draw.randrange(0x10000, 0x11000)]))
                       for _ in range(40))
        assert [t.decode() for t in lexical.terms_of(text)] == cut(text)
    assert words and lexical.terms_of(None) == []
