import hashlib
from collections import defaultdict

import pytest

from postmill.llm import exact_dedup
from llm_tables import messy_rows


def brute(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    out = []
    for i, t, *_ in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


# With 4 bits, digests clash and the comparison of full texts decides; 300 bytes a batch makes several.
@pytest.mark.parametrize("bits, batch", [(256, 16 << 30), (4, 16 << 30), (256, 300)])
def test_against_brute_force(messy, bits, batch):
    got = exact_dedup.exact_dedup(messy, bits, batch)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(messy_rows())


def test_empty(empty):
    assert exact_dedup.exact_dedup(empty).collect() == []


def test_no_python_in_plan(messy):
    plan = exact_dedup.exact_dedup(messy)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
