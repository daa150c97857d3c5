import time
from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from postmill.fixed import DATE_PATTERNS, WEEKDAY
from postmill.functions import text as t
from postmill.functions import values as v
from postmill.queries import all_queries


def one(spark, column, *cells, schema=None):
    names = [f"c{i}" for i in range(len(cells))]
    frame = spark.createDataFrame([cells], schema or ", ".join(f"{n} string" for n in names))
    return frame.select(column(*[F.col(n) for n in names]).alias("x")).first()["x"]


@pytest.mark.parametrize("raw, clean", [
    (None, ""), ("", ""), ("  a \n b\t", "a b"), ("a  b", "a b"), ("a\x1cb", "a b")])
def test_squash(spark, raw, clean):
    assert one(spark, t.squash, raw) == clean


def test_strip_keeps_inner_space(spark):
    assert one(spark, t.strip, "  a  b \n") == "a  b"


def test_drop_urls(spark):
    assert one(spark, t.drop_urls, "see HTTPS://x.org/api/ or Www.y.org now") == "see or now"
    assert one(spark, t.drop_urls, "no address") == "no address"


def test_fold_keeps_offsets(spark):
    raw = "İıſKÄB"
    assert one(spark, t.fold, raw) == "iiskäb"


@pytest.mark.parametrize("raw, fold_case, code_point", [
    (["b", "A ", "a", " ", "A"], "A|a|b", "A|a|b"),
    (["beta", "Zeta", "alpha"], "alpha|beta|Zeta", "Zeta|alpha|beta"),
    ([], "", ""), (None, "", "")])
def test_pipe_list(spark, raw, fold_case, code_point):
    frame = spark.createDataFrame([(raw,)], "a array<string>")
    row = frame.select(t.pipe_list(F.col("a")), t.pipe_list(F.col("a"), False)).first()
    assert tuple(row) == (fold_case, code_point)


@pytest.mark.parametrize("raw, expected", [
    (None, ""), ([], "Worldwide"), (['{"name": "Spain", "x": 1}', "canada", "Spain "], "canada|Spain"),
    (['{"code": 1}'], "")])
def test_location_list(spark, raw, expected):
    frame = spark.createDataFrame([(raw,)], "a array<string>")
    assert frame.select(t.location_list(F.col("a"))).first()[0] == expected


def test_fingerprint_value(spark):
    got = one(spark, t.fingerprint, "TELUS  Digital", "Online Data Analyst Canada", "canada ")
    assert got == "4055a15641a78658407a"


@pytest.mark.parametrize("html, plain", [
    (None, ""), ("<p>a<b>b</b>c</p>", "a b c"), ("a<!-- <p>x</p> -->b", "a b"),
    ("<SCRIPT type='x'>if (a<b) {}</script >t<style>p{}</style>", "t"),
    ("&lt;b&gt; &amp;lt; &quot;x&quot;&nbsp;&copy;", "<b> &lt; \"x\" ©"),
    ("caf&#233; &#x1F600;! &#0; &#; &#xD800; a&#38;b", "café \U0001F600! &#0; &#; &#xD800; a&b")])
def test_html_to_text(spark, html, plain):
    assert one(spark, t.html_to_text, html) == plain


@pytest.mark.parametrize("raw, loose", [
    (" TRUE ", True), ("0", False), ("yes", True), ("No", False), ("y", None), ("maybe", None),
    (None, None)])
def test_loose_bool(spark, raw, loose):
    assert one(spark, v.loose_bool, raw) is loose


def test_strict_bool(spark):
    assert one(spark, v.strict_bool, "Y") is True and one(spark, v.strict_bool, "n") is False
    assert one(spark, v.strict_bool, None) is None
    with pytest.raises(PySparkException):
        one(spark, v.strict_bool, "maybe")


@pytest.mark.parametrize("raw, unit, expected", [
    ("1700000000", "s", datetime(2023, 11, 14, 22, 13, 20)),
    ("1700000000000", "ms", datetime(2023, 11, 14, 22, 13, 20)),
    ("1784443000", "ms", datetime(1970, 1, 21, 15, 40, 43)),
    ("2026-07-08T13:02:27", "s", datetime(2026, 7, 8, 13, 2, 27)),
    ("2026-07-08T13:02:27+02:00", "s", datetime(2026, 7, 8, 11, 2, 27)),
    ("soon", "s", None), (None, "s", None)])
def test_parse_instant(spark, raw, unit, expected):
    assert one(spark, lambda c: v.parse_instant(c, unit), raw) == expected


def test_unknown_epoch_unit():
    with pytest.raises(ValueError):
        v.parse_instant(F.lit("1"), "min")


def test_iso_z(spark):
    assert one(spark, lambda c: v.iso_z(v.parse_stamp(c)), "20260131_235958") == "2026-01-31T23:59:58Z"


@pytest.mark.parametrize("low, high, currency, period, expected", [
    (50000.0, 70000.5, "USD", " Annual ", "50,000–70,000.50 USD per annual"),
    (50000.0, None, "", None, "From 50,000"), (None, 0.0, "EUR", "", "Up to 0 EUR"),
    (None, None, "USD", "annual", ""), (1234567.0, 1234567.25, None, "hour",
                                       "1,234,567–1,234,567.25 per hour")])
def test_salary_text(spark, low, high, currency, period, expected):
    got = one(spark, v.salary_text, low, high, currency, period,
              schema="c0 double, c1 double, c2 string, c3 string")
    assert got == expected


def test_numbers_and_shares(spark):
    assert one(spark, v.to_number, "12.5") == 12.5 and one(spark, v.to_number, "12k") is None
    assert one(spark, lambda c: v.percent(F.lit(1), F.lit(3)), "x") == 33.33
    assert one(spark, lambda c: v.ratio(F.lit(1), F.lit(0)), "x") is None


# Numbers and dates in hard spellings, with what they mean.
NUMBER_CASES = (
    ("12", 12.0), (" -3.5 ", -3.5), ("1e3", 1000.0), (".5", 0.5), ("7.", 7.0), ("1d", None), ("5f", None),
    ("nan", None), ("Infinity", None), ("0x10", None), ("1,000", None), ("", None), ("+2", 2.0),
)

DATE_CASES = (
    ("1700000000", "2023-11-14 22:13:20"), ("nan", None), ("Infinity", None), ("1e30", None),
    ("99999999999999999", None), ("-99999999999999", None), ("2025/01/05", "2025-01-05 00:00:00"),
    ("January 5, 2025", "2025-01-05 00:00:00"), ("Sun, 05 Jan 2025 10:20:30 GMT", "2025-01-05 10:20:30"),
    ("Sunday, 5 January 2025", "2025-01-05 00:00:00"), ("05 Jan 2025 10:20:30 +0200", "2025-01-05 08:20:30"),
    ("1/5/2025 7:08", "2025-01-05 07:08:00"), ("2026-07-08T13:02:27+02:00", "2026-07-08 11:02:27"),
    ("2026-13-40", None), ("soon", None), ("", None),
)


def test_number_cases(spark):
    rows = spark.createDataFrame(list(enumerate(c[0] for c in NUMBER_CASES)), "n int, raw string")
    got = {r.n: r.x for r in rows.select("n", v.to_number(F.col("raw")).alias("x")).collect()}
    assert [got[i] for i in range(len(NUMBER_CASES))] == [c[1] for c in NUMBER_CASES]


def test_date_cases(spark):
    rows = spark.createDataFrame(list(enumerate(c[0] for c in DATE_CASES)), "n int, raw string")
    at = F.date_format(v.parse_instant(F.col("raw")), "yyyy-MM-dd HH:mm:ss")
    got = {r.n: r.x for r in rows.select("n", at.alias("x")).collect()}
    assert [got[i] for i in range(len(DATE_CASES))] == [c[1] for c in DATE_CASES]


def test_shapes_rule_out_no_pattern(spark):
    """Every pattern's own writing, and texts of near shapes, against all patterns tried on all."""
    at = F.lit("2025-01-05 10:20:30").cast("timestamp")
    frame = spark.range(1).select(F.explode(F.array(
        *[F.date_format(at, p) for p in DATE_PATTERNS],
        *[F.lit(t) for t in ("5 jan 2025 1:2:3 America/New_York", "1/5/2025,", "Jan 5 2025 7:08", "2025/1/5 7",
                             "Sun 5 MAY 2025", "5 Jan 2025 7:08 +0200", "1/5/2025 7:08 GMT", "5, 2025")])).alias("raw"))
    bare = F.regexp_replace(F.regexp_replace(F.col("raw"), WEEKDAY, ""), r"\s+", " ")
    plain = F.coalesce(F.try_to_timestamp("raw"), *[F.try_to_timestamp(bare, F.lit(p)) for p in DATE_PATTERNS])
    rows = frame.select("raw", v.parse_date_text(F.col("raw")).alias("got"), plain.alias("want")).collect()
    assert [r for r in rows if r.got != r.want] == []
    assert all(r.got for r in rows[:len(DATE_PATTERNS) + 1])


def test_date_cases_query_has_table_dates_and_hard_cases(spark, tmp_path):
    rows = [(i, f"2024-0{1 + i % 9}-1{i % 10} 0{i % 10}:02:03") for i in range(48)]
    spark.createDataFrame(rows, "o_orderkey bigint, o_orderdate string").withColumn(
        "o_orderdate", F.col("o_orderdate").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: r for r in all_queries()["date_cases"](spark, str(tmp_path)).collect()}
    assert len(got) == 48
    for i, text in rows:
        want = DATE_CASES[i % len(DATE_CASES)][1]
        assert str(got[i].case_at) == str(want)
        assert str(got[i].at) == (text[:10] + " 00:00:00" if i % 6 in (0, 1, 3) else text)


def test_html_plan_is_built_quickly(spark):
    t.html_to_text(F.col("html"))
    start = time.perf_counter()
    t.html_to_text(F.col("html"))
    assert time.perf_counter() - start < 0.2
