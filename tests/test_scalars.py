"""Scalar functions against the Python standard library; many drawn values in one job each."""

from __future__ import annotations

import re
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gavel.functions import scalars as X

FEW = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def apply(spark, values, f, schema="v string"):
    rows = spark.createDataFrame([(n, v) for n, v in enumerate(values)], f"n int, {schema}")
    return [r.out for r in rows.select("n", f(F.col("v")).alias("out")).orderBy("n").collect()]


def python_date(text, form):
    try:
        return datetime.strptime(text, form).date() if text else None
    except ValueError:
        return None


dates = st.one_of(
    st.dates().map(str), st.from_regex(r"\A[0-9]{1,4}-[0-9]{1,2}-[0-9]{1,2}\Z"), st.sampled_from(["", "2026-02-30", "26-3-5", "x", "2026-3-5 ", "12026-03-05"]), st.none()
)


@FEW
@given(st.lists(dates, min_size=30, max_size=60))
def test_lenient_date(spark, values):
    values = [v for v in values if not (v or "").startswith("0000")]
    want = [python_date(v, "%Y-%m-%d") if v and re.fullmatch(r"\d{4}-\d{1,2}-\d{1,2}", v) else None for v in values]
    assert apply(spark, values, X.lenient_date) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("2026-03-05", "2026-03-05"), ("2026-03-05T23:59:59Z", "2026-03-05"), ("2026-03-05T01:00:00+09:00", "2026-03-05"), ("2026", None), ("2026-01", None),
     ("2026-1-1", None), ("2026-01-01 garbage", None), ("2026-01-01Tx", None), ("2026-02-30", None), (None, None), ("", None)],
)
def test_written_date(spark, text, want):
    (found,) = apply(spark, [text], X.written_date)
    assert (str(found) if found else None) == want


def test_dates_by_month_name(spark):
    values = ["Heard Mar 5, 2026 at noon", "Feb 30, 2026", "mar 5, 2026", None, "", "Dec  31,  1999", "Jan 1, 2026 and Feb 2, 2027"]
    assert [str(x) for x in apply(spark, values, X.month_name_date)] == ["2026-03-05", "None", "None", "None", "None", "1999-12-31", "2026-01-01"]


def test_seen_times(spark):
    values = ["20260305T120000Z", "20260305", "", None, "20261305T120000Z"]
    found = apply(spark, values, X.seen_timestamp)
    assert found[0] == datetime(2026, 3, 5, 12) and found[1:] == [None] * 4


@FEW
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é…", max_size=12)), min_size=20, max_size=40))
def test_shortened(spark, values):
    want = [v if v is None or len(v) <= 8 else v[:7] + "…" for v in values]
    assert apply(spark, values, lambda c: X.shortened(c, 8)) == want


@FEW
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab; ,", max_size=12)), min_size=20, max_size=40))
def test_parts(spark, values):
    want = [[p.strip(" ") for p in (v or "").split(";") if p.strip(" ")] for v in values]
    assert apply(spark, values, lambda c: X.parts(c, ";")) == want


NAMES = ["Lake County", "Miami-Dade County", "Miami"]


@FEW
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["Lake", "lake county", "Miami", "MIAMI-DADE COUNTY", "x", "Miamis", "É"]), max_size=5).map(" ".join)), min_size=20, max_size=40))
def test_tagged_names(spark, values):
    want = [[n for n in NAMES if re.search(rf"\b{re.escape(n)}\b", v or "", re.IGNORECASE)] for v in values]
    assert apply(spark, values, lambda c: X.tagged_names(c, NAMES)) == want


def test_county_wins_over_city(spark):
    texts = ["In Miami and Lake County", "in miami", "elsewhere", None]
    found = apply(spark, texts, lambda c: X.geo_scope(c, ["Lake County"], ["Miami"], "statewide", ["FL"]))
    assert [(s.scope_type, s.scope_names) for s in found] == [("county", ["Lake County"]), ("city", ["Miami"]), ("statewide", ["FL"]), ("statewide", ["FL"])]


def test_like_patterns():
    assert X.like_pattern("a%_b") == "%a%_b%"
    assert X.like_pattern(r"\q\%") == r"%q\%%"
    assert X.like_pattern("end\\") == r"%end\\%"


def test_small_rules(spark):
    row = spark.range(1).select(
        X.first_filled(F.lit(""), F.lit(None).cast("string"), F.lit("x"), default="d").alias("a"),
        X.chamber(F.lit("sb 12")).alias("b"), X.agenda_session(F.lit("2026-01-02T00:00:00")).alias("c"), X.agenda_session(F.lit(None).cast("string")).alias("d"),
        X.status_name(F.lit(4)).alias("e"), X.status_name(F.lit(9), F.lit(7)).alias("f"), X.status_name(F.lit(None).cast("int")).alias("g"),
        X.client_address(F.lit(""), F.lit(" 1.2.3.4 , 5.6.7.8")).alias("h"), X.without_demo_mark(F.lit("A (DEMO) b (DEMO)")).alias("i"),
        X.shade(F.lit(3)).alias("j"), X.page_count(F.lit(0), 50).alias("k"), X.page_number(F.lit(50), 50).alias("l"),
        X.merged(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("a"), F.lit("3"))).alias("m"),
        X.default_jurisdiction(F.lit("US"), F.lit("Florida"), F.lit("miami"), ("US", "Florida"), ["Miami"], "FL").alias("n"),
        X.sponsor_line(F.array(F.struct(F.lit("A").alias("name"), F.lit("sponsor").alias("relationship_type")), F.struct(F.lit("B").alias("name"), F.lit("co_sponsor").alias("relationship_type")))).alias("o"),
    ).first()
    assert tuple(row) == ("x", "Senate", "2026", "current", "Passed", "7", "Introduced", "1.2.3.4", "A b (DEMO)", "2-3", 1, 2, {"a": "3", "b": "2"}, "Miami", "A, B (co-sponsor)")


def test_a_present_null_is_not_missing(spark):
    rows = spark.sql("SELECT map('k', cast(null AS string)) AS m UNION ALL SELECT map('z', '1')")
    assert sorted(str(r.v) for r in rows.select(X.value_or_missing(F.col("m"), "k", F.lit("d")).alias("v")).collect()) == ["None", "d"]
