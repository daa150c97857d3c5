import random
import resource
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postmill.llm import decontaminate as dc
from llm_tables import docs_table, messy_rows, words


def folded(text):
    return dc.folded(text).tobytes().decode("utf-32-le")


def least_edits(piece, text):
    """Plain edit distance of ``piece`` to the closest run of ``text``."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(piece, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def brute(text, items):
    """Item ids with some piece within its budget anywhere in the text."""
    index, line = dc.build_index(items), folded(text or "")
    return sorted({index.items[p] for p, piece in enumerate(index.texts) if least_edits(piece, line) <= index.budgets[p]})


def edited(draw, text, edits):
    chars = list(text)
    for _ in range(edits):
        at = draw.randrange(len(chars))
        kind = draw.randrange(3)
        chars[at:at + (kind != 1)] = [] if kind == 0 else [draw.choice("abcxyz")]
    return "".join(chars)


@pytest.fixture(scope="module")
def bench():
    draw = random.Random(8)
    return [(i, words(draw, n)) for i, n in enumerate((20, 35, 60, 24, 5, 3))] + [(90, None), (91, ""), (92, "tiny"), (93, "!?")]


def cases(bench):
    draw, rows = random.Random(6), []
    for i in range(70):
        _, text = bench[i % 5]
        a = draw.randrange(2) * draw.randrange(max(1, len(text) - 160))
        part = edited(draw, text[a:a + draw.choice((120, 170, 400))], draw.choice((0, 1, 3, 5, 8, 12, 20)))
        part = draw.choice((str.upper, str, lambda t: t.replace(" ", "***\n"), str.title))(part)
        rows.append((i, f"{words(draw, draw.randrange(30))} {part} {words(draw, draw.randrange(30))}", "en", "a"))
    return rows


# Blocks of 100 characters take a pass for every item.
@pytest.mark.parametrize("block", [4 << 20, 100])
def test_against_brute_force(spark, bench, block):
    rows = cases(bench)
    benchmark = spark.createDataFrame(bench, "item_id bigint, text string")
    got = {r.doc_id: r for r in dc.contaminated(docs_table(spark, rows), benchmark, block).collect()}
    want = {i: brute(t, bench) for i, t, *_ in rows}
    assert {i: list(r.item_ids) for i, r in got.items()} == want
    assert 10 < sum(map(bool, want.values())) < len(rows)
    for i, t, *_ in rows:
        assert got[i].contaminated == bool(want[i]) == bool(got[i].spans)
        for span in filter(None, got[i].spans.split(",")):
            a, b = map(int, span.split(":"))
            assert 0 <= a < b <= len(t) and brute(t[a:b], bench)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab "), min_size=1, max_size=12), st.text(st.sampled_from("ab "), max_size=20))
def test_banded_alignment(piece, region):
    whole = dc.edit_distance_within(dc.codes(piece), dc.codes(region), -len(piece), len(region))
    assert whole[0] == least_edits(piece, region)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_origins(text):
    # A capital sigma at a word's end is the one letter whose lower case depends on its place.
    assert len(dc.origins(text)) == len(folded(text)) + 1
    assert dc.origins(text) == sorted(dc.origins(text))


def test_messy_rows_and_empty(spark, messy, empty, bench):
    benchmark = spark.createDataFrame([*bench, (7, messy_rows()[5][1])], "item_id bigint, text string")
    got = dc.contaminated(messy, benchmark).collect()
    assert len(got) == len(messy_rows())
    held = {r.doc_id for r in got if list(r.item_ids) == [7]}
    assert held == {i for i, t, *_ in messy_rows() if brute(t, [(7, messy_rows()[5][1])])} and held
    assert dc.contaminated(empty, benchmark).collect() == []
    assert not any(r.contaminated for r in dc.contaminated(messy, benchmark.limit(0)).collect())


def test_grams_are_of_runs():
    points = dc.codes("abcdefghij" * 3)
    hashes = dc.grams(points)
    assert len(hashes) == len(points) - dc.Q + 1
    assert (hashes[:10] == hashes[10:20]).all() and len(np.unique(hashes[:10])) == 10


def passages(draw, items):
    """(item, passage): 13 words and more, or 80 characters, from any offset."""
    for item, text in items:
        parts = folded(text).split()
        for n in 2 * (13, 13, 13, 14, 17, 20, 25, 30, 35):
            if len(parts) >= n:
                at = draw.randrange(len(parts) - n + 1)
                yield item, " ".join(parts[at:at + n])
        line = " ".join(parts)
        for _ in range(12):
            if len(line) >= 80:
                at = draw.randrange(len(line) - 79)
                yield item, line[at:at + 80]


def test_partial_passages(spark):
    """Without build_index: what is set in verbatim has to be found."""
    draw = random.Random(12)
    table = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()[::8]
    items = [(r.item_id, r.text) for r in table] + [
        (-1, "".join(draw.choice("abcdefghij") for _ in range(700))),
        (-2, " ".join(draw.choice("abcdefghij") for _ in range(60))),
        (-3, words(draw, 300, 10 ** 9)), (-4, " ".join(draw.choice(("ab", "c", "defgh" * 9)) + str(i) for i in range(80)))]
    index, tried = dc.build_index(items), 0
    for item, passage in passages(draw, items):
        text = f"{words(draw, draw.randrange(1, 40))} {passage} {words(draw, draw.randrange(1, 40))}"
        assert item in {index.items[p] for p, *_ in dc.find(text, index)}, (item, passage)
        tried += 1
    assert tried > 200


def test_half_passages_do_not_count(spark):
    draw = random.Random(13)
    items = [(i, words(draw, 60, 10 ** 6)) for i in range(40)]
    index = dc.build_index(items)
    for _, text in items:
        parts = text.split()
        at = draw.randrange(50)
        assert dc.find(f"{words(draw, 30)} {' '.join(parts[at:at + 5])} {words(draw, 30)}", index) == []


def test_repetitive_texts_take_bounded_memory():
    """Every place of such a text matches every place of such an item."""
    index = dc.build_index([(1, "ha ha " * 60), (2, " ".join(f"word{i}" for i in range(60)))])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    start = time.perf_counter()
    found = dc.find("ha ha " * 200_000, index)
    assert {index.items[p] for p, *_ in found} == {1} and len(found) <= len(index.texts)
    assert min(s for _, _, s, _ in found) == 0 and max(e for *_, e in found) >= 1_199_998
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000  # KB
    assert time.perf_counter() - start < 120


def test_slices_change_nothing(monkeypatch):
    draw = random.Random(4)
    items = [(i, words(draw, 60, 30)) for i in range(12)]
    index = dc.build_index(items)
    texts = [" ".join([words(draw, 30, 30), items[i % 12][1][draw.randrange(60):], words(draw, 200, 30)]) for i in range(20)]
    whole = [sorted(dc.find(t, index)) for t in texts]
    assert sum(map(len, whole)) > 20
    monkeypatch.setattr(dc, "SLICE_POSTINGS", 50)
    assert [sorted(dc.find(t, index)) for t in texts] == whole


def test_ten_blocks_are_one_result(spark):
    draw = random.Random(9)
    items = [(i, words(draw, 40, 5_000)) for i in range(40)]
    docs = [(i if i % 9 else None, words(draw, 50, 5_000) + " " + items[i % 40][1] + (" " + items[(i + 7) % 40][1]) * (i % 2), "en", "a")
            for i in range(60)]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    one, ten = (sorted(map(repr, dc.contaminated(docs_table(spark, docs), benchmark, n).collect())) for n in (8 << 20, 2_000))
    assert one == ten and all("contaminated=True" in r for r in one)


def test_quick_bound_is_the_least_edits():
    draw = random.Random(8)
    for _ in range(300):
        region = "".join(draw.choice("abc") for _ in range(draw.randrange(1, 40)))
        pattern = "".join(draw.choice("abc") for _ in range(draw.randrange(1, 14)))
        least = least_edits(pattern, region)
        assert dc.may_hold(region, pattern, least) and (least == 0 or not dc.may_hold(region, pattern, least - 1))
