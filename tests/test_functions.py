"""Scalar rules against Python / JavaScript-semantics models."""

import math
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens import functions as LF


def _eval(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {dtype}")
    return [r[0] for r in df.select(fn("v")).collect()]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False), min_size=1, max_size=200))
def test_round2_matches_numpy(spark, xs):
    got = _eval(spark, xs, LF.round2, "double")
    assert got == list(np.round(np.array(xs), 2))


def test_round2_ties_half_even(spark):
    assert _eval(spark, [0.125, 1.005, 2.675, 0.135], LF.round2, "double") == [0.12, 1.0, 2.68, 0.14]  # pandas .round(2)


WS = " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0        　"


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=WS + "ab nN", max_size=8), min_size=1, max_size=100))
def test_strip_matches_python(spark, xs):
    assert _eval(spark, xs, LF.strip) == [x.strip() for x in xs]


def test_safe_value(spark):
    got = _eval(spark, [None, " nan ", "NaN", " x ", "nano"], LF.safe_value)
    assert got == ["", "", "", "x", "nano"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab9 _-#éZ", max_size=10), min_size=1, max_size=100))
def test_slug_matches_python(spark, xs):
    model = [re.sub(r"[^a-zA-Z0-9]+", "_", x).strip("_").lower() for x in xs]
    assert _eval(spark, xs, LF.slug) == model


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="abcXY '-3é.", max_size=12), min_size=1, max_size=100))
def test_python_title(spark, xs):
    assert _eval(spark, xs, LF.python_title) == [x.title() for x in xs]


def test_vendor_title_case(spark):
    got = _eval(spark, ["axis bank", "QATAR BANK", "hdfc bank limited", "o'neil supplies", "", "3m india"],
                LF.vendor_title_case)
    assert got == ["Axis Bank", "Qatar Bank", "HDFC Bank Limited", "O'Neil Supplies", "Unspecified", "3M India"]


def _js_inr(v):
    n = math.floor(v + 0.5)
    s = str(abs(n))
    if len(s) > 3:
        head, tail = s[:-3], s[-3:]
        groups = []
        while len(head) > 2:
            groups.insert(0, head[-2:])
            head = head[:-2]
        if head:
            groups.insert(0, head)
        s = ",".join(groups) + "," + tail
    return "₹" + ("-" if n < 0 else "") + s


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(min_value=-1e10, max_value=1e10, allow_nan=False), min_size=1, max_size=100))
def test_inr_indian_grouping(spark, xs):
    assert _eval(spark, xs, LF.inr, "double") == [_js_inr(x) for x in xs]


def test_inr_short_and_crore(spark):
    xs = [123.4, 123456.0, 12345678.0, 10000000.0, -250000.0]
    assert _eval(spark, xs, LF.inr_short, "double") == ["₹123", "₹1.23 L", "₹1.23 Cr", "₹1.00 Cr", "₹-2.50 L"]
    assert _eval(spark, xs, LF.inr_crore, "double") == ["₹0 Cr", "₹0.01 Cr", "₹1.23 Cr", "₹1 Cr", "₹-0.03 Cr"]


def test_percent_int(spark):
    assert _eval(spark, [0.13, 0.125, None], LF.percent_int, "double") == ["13%", "13%", "—"]


def test_rate_and_percent_lists(spark):
    df = spark.createDataFrame([([12.0, 5.0, 2.5],)], "a array<double>")
    assert df.select(LF.rate_list("a")).first()[0] == "2.5, 5, 12"
    assert _eval(spark, ["5, 12%, , 2.5"], LF.percent_list) == ["5%, 12%, 2.5%"]


def test_tax_desc_python_float_text(spark):
    df = spark.createDataFrame([(9.0, 9.0), (2.5, 2.5), (0.0, 0.0)], "a double, b double")
    got = [r[0] for r in df.select(LF.tax_desc("a", "b")).collect()]
    assert got == ["9.0% CGST, 9.0% SGST", "2.5% CGST, 2.5% SGST", "0.0% CGST, 0.0% SGST"]


def test_excel_date(spark):
    from pyspark.sql.types import StringType

    vals = ["45292", "45292.5", "2024-01-15", "15/01/2024", "junk", ""]
    got = _eval(spark, vals, lambda c: LF.excel_date(c, StringType()))
    got = [g.strftime("%Y-%m-%d %H:%M") if g else None for g in got]
    assert got == ["2024-01-01 00:00", "2024-01-01 12:00", "2024-01-15 00:00", "2024-01-15 00:00", None, None]


def test_fiscal_year_label(spark):
    df = spark.createDataFrame([("1995-05-01",), ("1996-02-01",), ("1999-12-31",)], "d string")
    got = [r[0] for r in df.select(LF.fiscal_year_label(df.d.cast("date"))).collect()]
    assert got == ["1995-96", "1995-96", "1999-00"]


def test_entity_key_fallbacks(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("My Title!", "t", 0), ("", "Table 2", 1), ("", "", 5), ("###", "", 7)],
                               "a string, b string, n int")
    got = [r[0] for r in df.select(LF.entity_key("a", "b", F.col("n") + 2)).collect()]
    assert got == ["my_title", "table_2", "row_7", "row-9"]


def test_issue_slug_and_plus(spark):
    assert _eval(spark, ["Priya  Sharma"], LF.issue_slug) == ["priya-sharma"]
    assert _eval(spark, ["5 + 12+18"], LF.plus_to_comma) == ["5 ,  12, 18"]


def test_excel_date_forms(spark):
    from pyspark.sql import functions as F

    from ledgerlens.functions.dates import excel_date

    want = {
        "03/04/2024": "2024-03-04 00:00:00", "03-04-2024": "2024-03-04 00:00:00", "13/04/2024": "2024-04-13 00:00:00",
        "2024/01/31": "2024-01-31 00:00:00", "Jan 31, 2024": "2024-01-31 00:00:00", "31 January 2024": "2024-01-31 00:00:00",
        "5-Mar-2024": "2024-03-05 00:00:00", "2024-01-31T10:00:00Z": "2024-01-31 10:00:00", "2024-01-31": "2024-01-31 00:00:00",
        "2024-01-31 10:00:00.123": "2024-01-31 10:00:00", "03/04/2024 10:00 PM": "2024-03-04 22:00:00",
        "03/04/2024 12:30 am": "2024-03-04 00:30:00", "45322": "2024-01-31 00:00:00", "45322.5": "2024-01-31 12:00:00",
        "20240131": None, "nan": None, "1e300": None, "-1e300": None, "31/02/2024": None, "14/14/2024": None, "pending": None, "": None,
        "Xyz 3, 2024": None, "2024-13-01": None, "Infinity": None,
    }
    df = spark.createDataFrame([(k,) for k in want], "t string")
    got = {r.t: r.d for r in df.select("t", F.date_format(excel_date("t"), "yyyy-MM-dd HH:mm:ss").alias("d")).collect()}
    assert got == want


def test_two_digit_years_and_fractions(spark):
    from ledgerlens.functions.dates import excel_date

    forms = {
        "1/2/24": "2024-01-02 00:00:00", "5 Jan 24": "2024-01-05 00:00:00", "Jan 5, 24": "2024-01-05 00:00:00", "24-01-05": "2005-01-24 00:00:00",
        "1.2.98": "1998-01-02 00:00:00", "2024-01-05 10:00:00.123": "2024-01-05 10:00:00.123", "1/2/2024 1:02:03.1234567 pm": "2024-01-02 13:02:03.123456",
        "2024-1-5 7:08": "2024-01-05 07:08:00", "1/2/2024 10:00:61": None, "13/14/24": None, "1/2/245": None,
    }
    got = spark.createDataFrame([(k,) for k in forms], "t string").select("t", excel_date("t").cast("string").alias("d")).collect()
    assert {r.t: r.d for r in got} == forms


def test_a_missing_date_cell_stays_missing(spark):
    from ledgerlens.operators.purchase import purchase_enrich

    both = spark.createDataFrame([("1", "2024-05-01", None), ("2", "2024-05-01", ""), ("3", None, "2024-06-01")],
                                 "`bill no` string, `bill date time` string, `business day date` string")
    got = {r["bill no"]: (r["MONTH"], r["YEAR"], r["bill date time"] is None) for r in purchase_enrich(both).collect()}
    assert got == {"1": ("Unknown", 0, False), "2": ("Unknown", 0, False), "3": ("June", 2024, True)}
    one = purchase_enrich(both.drop("business day date").filter("`bill no` = '1'")).first()
    assert (one["MONTH"], one["YEAR"]) == ("May", 2024)
