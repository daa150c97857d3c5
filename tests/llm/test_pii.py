import hashlib
import random
import re
import resource
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postmill.llm import pii
from llm_tables import docs_table, messy_rows

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def digits(text):
    return re.sub("[^0-9]", "", text)


def plain_luhn(number):
    total = 0
    for i, c in enumerate(number[::-1]):
        total += sum(map(int, str(int(c) * 2))) if i % 2 else int(c)
    return total % 10 == 0


def brute(text):
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
            if 16 <= len(digits(m[0])) <= 19 and plain_luhn(digits(m[0]))]
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 8 <= len(digits(m[0])) <= 15]
    return out


@settings(max_examples=1_500, deadline=None)
@given(st.text(st.sampled_from("a@.-+1 24(é_%"), max_size=60))
def test_patterns_against_plain_ones(text):
    assert pii.base_spans(text) == brute(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "4111111111111111", "+1 (743) 555-3824", "a@b.co", "1.2.3.4", ".", " ",
                                 "@", "999.1.1.1", "007.08.9.255", "12-", "+", "é"]), max_size=12).map("".join))
def test_patterns_side_by_side(text):
    assert pii.base_spans(text) == brute(text)


def test_long_runs_take_linear_time():
    for run in ("a" * 2_000_000, "1" * 2_000_000, "1." * 500_000, "+1" * 500_000, "@" * 500_000, "a@" * 300_000):
        pii.zones(run, pii.base_spans(run))


@pytest.fixture(scope="module")
def people(spark):
    rows = [(i, f"w{i} write to user.{i}@mail{i % 7}.example.com today. Call +1 ({200 + i}) 555-{1000 + 7 * i} or see "
                f"{i % 200}.{i % 90}.7.{i % 250} paid by 4111 1111 1111 1111 thanks for {i * 37_111_111} things", "en", "a")
            for i in range(60)]
    return docs_table(spark, rows)


def test_field_adds_what_patterns_miss(spark):
    model = pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    texts = {1: "call (743) 555-3824 now", 2: "write to thin.19 [at] mail5 [dot] example [dot] com please",
             3: "ip 152[.]143[.]123[.]131 seen", 4: "the dot at the end is black", 5: "in 2020-01-02 we had 1234567 things"}
    got = {r.doc_id: r for r in pii.personal_data(docs_table(spark, [(i, t, "en", "a") for i, t in texts.items()]), model).collect()}
    assert got[1].spans == "phone:5:19" and got[1].n_added == 1 and got[1].n_phone == 0
    assert got[2].spans == f"email:9:{texts[2].index(' please')}"
    assert got[3].spans == f"ip:3:{texts[3].index(' seen')}"
    assert got[4].spans == "" and got[5].spans == ""


def test_base_spans_stay(people):
    model = pii.train(people)
    truth = {r.doc_id: r.text for r in people.collect()}
    for r in pii.personal_data(people, model).collect():
        want = brute(truth[r.doc_id])
        listed = [f"{k}:{s}:{e}" for k, s, e in want]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(w[0] == k for w in want) for k in pii.KINDS)
        spans = r.spans.split(",")
        assert set(listed) <= set(spans) and len(spans) == len(listed) + r.n_added
        place = sorted(tuple(map(int, x.split(":")[1:])) for x in spans if x not in listed)
        assert all(a[1] <= b[0] for a, b in zip(place, place[1:]))


def test_dynamic_program_against_all_cuts():
    model = pii.SemiMarkov({("phone", "bias"): 1.0, ("phone", "digits=7"): 2.0, ("ip", "digits=4"): 1.5, ("card", "bias"): -1.0})
    tokens = pii._TOKEN.findall("a 123 4567 12.34 x")
    arcs = model.scored(pii.candidates(tokens))

    def cuts(at):
        if at == len(tokens):
            yield 0.0, ()
            return
        for score, rest in cuts(at + 1):
            yield score, rest
        for x, (i, j, _, s) in enumerate(arcs):
            if i == at:
                for score, rest in cuts(j):
                    yield score + s, (x, *rest)

    every = list(cuts(0))
    best = max(every)
    assert sum(arcs[x][3] for x in model.best(len(tokens), arcs)) == pytest.approx(best[0])
    from math import exp
    total = sum(exp(s) for s, _ in every)
    for x, p in enumerate(model.posterior(len(tokens), arcs)):
        assert p == pytest.approx(sum(exp(s) for s, c in every if x in c) / total)


def test_messy_rows_and_empty(messy, empty, people):
    model = pii.train(empty)
    got = pii.personal_data(messy, model).collect()
    assert len(got) == len(messy_rows()) and all(r.n_added == 0 for r in got)
    assert pii.personal_data(empty, pii.train(people)).collect() == []


class Form:
    """Draws the forms of ``rewritten`` one after the other."""

    def __init__(self, n):
        self.n = n

    def integers(self, many):
        return self.n % many


@pytest.mark.parametrize("kind, values", [
    ("email", ["a@b.co", "jane.roe@example.com", "x_1%y+z-9@mail5.sub.example.org"]),
    ("ip", ["8.8.4.4", "10.0.0.1", "10.0.12.7", "1.22.3.4", "152.143.123.131"]),
    ("card", ["4111 1111 1111 1111", "4111111111111111"]), ("phone", ["+1 (743) 555-3824", "+49 30 1234567890"])])
def test_every_rewrite_lies_in_a_zone(kind, values):
    for value in values:
        for n in range(20):
            form = pii.rewritten(kind, value, Form(n))
            # "name at host dot tld" is a zone by its dot.
            for text in (form, f"see {form} now", f"({form})", f"from 1.2.3.4 or a@b.co {form} and ü"):
                at, base = text.rindex(form), pii.base_spans(text)
                if any(s < at + len(form) and e > at for _, s, e in base):
                    continue  # a pattern finds it, or part of it, already
                assert any(a <= at and at + len(form) <= b for a, b in pii.zones(text, base)), text


def luhn_card(draw):
    digits = [draw.randrange(10) for _ in range(15)]
    odd = sum(digits[1::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[0::2])
    text = "".join(map(str, [*digits, -odd % 10]))
    return " ".join(text[i:i + 4] for i in range(0, 16, 4))


def test_recall_of_rewritten_values(spark):
    """Values rewritten in other ways, set into documents that took no part in training."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = pii.train(docs.filter("doc_id % 2 = 0"))
    texts = [r.text for r in docs.filter("doc_id % 2 = 1").select("text").collect() if 50 < len(r.text) < 4_000]
    draw, rng = random.Random(6), np.random.default_rng(6)

    def added(text):
        base, out = pii.base_spans(text), []
        for a, b in pii.zones(text, base):
            out += [(k, a + s, a + e) for k, s, e in model.find(text[a:b], text[a - 1:a] if a else "", text[b:b + 1])]
        return pii.apart_from(out, base)

    false = sum(len(added(t)) for t in texts)
    tried, found = Counter(), Counter()
    for n in range(400):
        kind = pii.KINDS[n % 4]
        value = {"email": f"{draw.choice(['jane', 'k.roe', 'x_12', 'tom-b'])}@{draw.choice(['mail', 'post7', 'a-b'])}.example.{draw.choice(['com', 'org', 'de'])}",
                 "ip": ".".join(str(draw.randrange(256)) for _ in range(4)), "card": luhn_card(draw),
                 "phone": f"+1 {draw.randrange(200, 999)} {draw.randrange(200, 999)} {draw.randrange(1000, 9999)}"}[kind]
        form, words = pii.rewritten(kind, value, rng), texts[n % len(texts)].split(" ")
        at = draw.randrange(len(words) + 1)
        text = " ".join([*words[:at], form, *words[at:]])
        begin = len(" ".join(words[:at])) + (at > 0)
        if any(s < begin + len(form) and e > begin for _, s, e in pii.base_spans(text)):
            continue
        tried[kind] += 1
        found[kind] += any(k == kind and s <= begin + 1 and e >= begin + len(form) - 1 for k, s, e in added(text))
    print({k: (found[k], tried[k]) for k in tried}, "false", false, "of", len(texts))
    assert sum(found.values()) >= 0.9 * sum(tried.values()) and false <= 0.05 * len(texts)


def test_long_tables_take_bounded_memory():
    model = pii.SemiMarkov({("phone", "digits=10"): 1.0})
    draw = random.Random(2)
    text = " ".join(str(draw.randrange(10 ** 6)) for _ in range(12_000))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    model.find(text)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000  # KB


def test_many_base_spans_take_linear_time():
    text = " ".join(f"+1 (743) 555-{n:04d}, 123456{n:04d}x" for n in range(9_000))
    start = time.perf_counter()
    base = pii.base_spans(text)
    zones = pii.zones(text, base)
    spans = [("phone", a, b) for a, b in zones]
    assert len(pii.apart_from(spans, base)) <= len(spans) and len(base) == 9_000
    assert time.perf_counter() - start < 5


def test_stretches_find_what_the_whole_zone_holds(people):
    model = pii.train(people)
    zone = " ".join(["filler words here (743) 555-3824 and more"] * 60)
    assert model.find(zone, stretch=50) == model.find(zone, stretch=10_000)
