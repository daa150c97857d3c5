import random
import re

import numpy as np
import pytest
import xxhash

from postmill.llm import simhash
from postmill.llm.components import components
from llm_tables import docs_table, messy_rows, words


def slow_print(text):
    parts = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not parts:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(parts[i:i + 4]).encode(), 42) for i in range(max(1, len(parts) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, radius=4):
    prints = [slow_print(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((r[0], f"{prints[i]:016x}", min(ids, default=None)))
    return sorted(out, key=repr)


# Blocks of 3 cut nearly every bucket into several.
@pytest.mark.parametrize("block", [4_096, 3])
def test_against_brute_force(messy, block):
    got = simhash.near_duplicates(messy, block=block)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(messy_rows())


def test_chains_of_near_copies(spark):
    draw, rows = random.Random(5), []
    for base in range(6):
        text = words(draw, 150)
        for i in range(12):
            rows.append((100 * base + i, text, "en", "a"))
            parts = text.split()
            parts[draw.randrange(len(parts))] = f"new{i}"
            text = " ".join(parts)
    want = brute(rows)
    assert len({w[2] for w in want}) < len(rows) / 2
    assert sorted(map(tuple, simhash.near_duplicates(docs_table(spark, rows), block=5).collect()), key=repr) == want


@pytest.mark.parametrize("n", [100, 10_000_000, 10 ** 13])
def test_thresholds_keep_the_pigeonhole(n):
    sample = np.random.default_rng(1).integers(0, 2 ** 63, 500, dtype=np.int64).view(np.uint64)
    probes = simhash.plan_probes(sample, n)
    used = [b for p in probes for b in p.bits]
    assert len(used) == len(set(used))
    # Every way to turn 4 bits leaves some probe within its threshold.
    draw = random.Random(2)
    for _ in range(2_000):
        turned = set(draw.sample(range(64), 4))
        assert any(len(turned & set(p.bits)) <= p.threshold for p in probes)


def test_unequal_thresholds_find_all(spark):
    groups = simhash.correlated_groups(np.random.default_rng(4).integers(0, 2 ** 63, 300, dtype=np.int64).view(np.uint64), 3)
    probes = [simhash.Probe(groups[0], 2), simhash.Probe(groups[1], 0), simhash.Probe(groups[2], 0)]
    draw, prints = random.Random(9), []
    for _ in range(40):
        p = draw.getrandbits(64)
        prints += [p, p ^ sum(1 << b for b in draw.sample(range(64), 4)), p ^ sum(1 << b for b in draw.sample(range(64), 5))]
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(x,) for x in signed], "print bigint")
    found = {r.node: r.root for r in components(simhash.links(frame, probes, block=4)).collect()}
    for i in range(0, len(prints), 3):
        assert found[signed[i]] == found[signed[i + 1]]
        assert found.get(signed[i + 2]) != found[signed[i]]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}


def test_empty(empty):
    assert simhash.near_duplicates(empty).collect() == []
