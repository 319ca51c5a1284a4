"""Literal input and output of every normaliser."""

import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyframe.functions import normalize as N
from tallyframe.functions.similarity import indel_ratio, sorted_name_score
from tallyframe.functions.status import normalize_status, read_status
from tallyframe.functions.text import token_sort


def apply(spark, fn, values):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, v string")
    return [r.out for r in df.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()]


def test_pan(spark):
    good = ["abcde1234f", "ABCDE-1234-F", "ABCDE/1234/F", " ABCDE 1234 F "]
    assert apply(spark, N.pan, good) == ["ABCDE1234F"] * 4
    bad = ["ABCD1234F", "ABCDEF1234F", "ABCDE12345", "12345ABCDE", "", None]
    assert apply(spark, N.pan, bad) == [None] * 6
    errors = apply(spark, N.pan_error, bad)
    assert errors[0] == "Invalid PAN format: 'ABCD1234F' (normalized: 'ABCD1234F')"
    assert errors[-1] == errors[-2] == "PAN cannot be empty"
    assert apply(spark, N.pan_error, good) == [None] * 4


def test_name(spark):
    cases = {
        "Mr. Ramesh Kumar Sharma": "RAMESH KUMAR SHARMA",
        "M/s Ramesh Sharma": "RAMESH SHARMA",
        "Ramesh Sharma / Jt. Holder": "RAMESH SHARMA",
        "Ramesh Sharma HUF": "RAMESH SHARMA",
        "Huffman": "HUFFMAN",
        "Mr. Jt. Joint HUF": "",
        "Ramesh - Kumar, Sharma / Jt.": "RAMESH KUMAR SHARMA",
        "Late Dr. José  Müller": "JOSÉ MÜLLER",
        None: "",
    }
    assert apply(spark, N.name, list(cases)) == list(cases.values())


def test_mobile(spark):
    cases = {
        "+91-98765 43210": "9876543210",
        "09876543210": "9876543210",
        "9876543210": "9876543210",
        "9999999999": None,
        "1234567890": None,
        "0123456789": None,
        "12345": None,
        None: None,
    }
    assert apply(spark, N.mobile, list(cases)) == list(cases.values())
    errors = apply(spark, N.mobile_error, ["12345", "9999999999", "1234567890", None, "9876543210", ""])
    assert errors == [
        "Mobile number must normalize to exactly 10 digits: '12345' (normalized: '12345')",
        "Mobile number is an obvious repeating dummy: '9999999999'",
        "Mobile number is a placeholder dummy: '1234567890'",
        None,
        None,
        "Mobile number cannot be empty",
    ]


def test_email(spark):
    good = ["User@Example.COM", " a.b+c@mail.example.co.in ", "x_y@d-e.org"]
    assert apply(spark, N.email, good) == ["user@example.com", "a.b+c@mail.example.co.in", "x_y@d-e.org"]
    bad = ["plain", "a@b", "a..b@c.com", ".a@c.com", "a@-b.com", "a@b-.com", "a@b.local", "a b@c.com", "a@b.123", "@c.com"]
    assert apply(spark, N.email, bad) == [None] * len(bad)
    assert apply(spark, N.email_error, ["plain", None, "a@b.co"]) == ["Invalid email format: 'plain'", None, None]


def test_date(spark):
    same = ["2026-06-13", "13-06-2026", "13/06/2026", "13-Jun-2026", "13-JUN-2026", "13-jun-2026",
            "13-June-2026", "2026/06/13", "Jun 13, 2026", "13 Jun 2026"]
    assert apply(spark, N.date, same) == [dt.date(2026, 6, 13)] * len(same)
    assert apply(spark, N.date, ["45000", "45000.75", "59", "61", "1", "60"]) == [
        dt.date(2023, 3, 15), dt.date(2023, 3, 15), dt.date(1900, 2, 28), dt.date(1900, 3, 1),
        dt.date(1900, 1, 1), dt.date(1900, 2, 28)]
    bad = ["", "bad", "31-02-2026", "100001", "0", "13-Juno-2026", "2026-13-01", None]
    assert apply(spark, N.date, bad) == [None] * len(bad)
    assert apply(spark, N.date_error, ["", "bad", None, "2026-06-13"]) == [
        "Date value cannot be empty", "Unable to parse date: 'bad'", "Date value cannot be None", None]


def test_amount(spark):
    out = apply(spark, N.amount, ["12,345.67", "", None, "1e3", " 5 ", "abc", "12.34.56"])
    assert out == [Decimal("12345.67"), 0, 0, 1000, 5, None, None]
    assert apply(spark, N.amount_error, ["abc", "1"]) == ["Invalid amount format: 'abc'", None]


@pytest.mark.parametrize(
    "fn,field,cases",
    [
        (read_status, "kyc_status", {"k": "VERIFIED", "KRA-Compliant": "VERIFIED", "exempted": "EXEMPT", "?": "UNKNOWN"}),
        (read_status, "fatca_status", {"nc": "NON_COMPLIANT", "c": "COMPLIANT", "submitted": "PENDING"}),
        (read_status, "investor_status", {"a": "ACTIVE", "frozen": "SUSPENDED", " closed ": "INACTIVE"}),
        (normalize_status, "kyc_status", {"invalid_status": "UNKNOWN", "verified": "VERIFIED", "under process": "PENDING", "K": "UNKNOWN"}),
        (normalize_status, "fatca_status", {"non-compliant": "NON_COMPLIANT", "NC": "UNKNOWN"}),
        (normalize_status, "investor_status", {"active status": "ACTIVE", "A": "UNKNOWN"}),
    ],
)
def test_status(spark, fn, field, cases):
    assert apply(spark, lambda c: fn(c, field), list(cases)) == list(cases.values())
    assert apply(spark, lambda c: fn(c, field), [None]) == ["UNKNOWN"]


def common_subsequence(a, b):
    grid = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            grid[i + 1][j + 1] = grid[i][j] + 1 if x == y else max(grid[i][j + 1], grid[i + 1][j])
    return grid[-1][-1]


@given(st.text("abcd é", max_size=80), st.text("abcd é", max_size=80))
@settings(max_examples=200, deadline=None)
def test_indel_ratio_against_quadratic_definition(a, b):
    total = len(a) + len(b)
    expected = 100.0 if total == 0 else 200.0 * common_subsequence(a, b) / total
    assert indel_ratio(a, b) == pytest.approx(expected, abs=1e-9)
    assert indel_ratio(a, b) == indel_ratio(b, a)
    assert 0.0 <= indel_ratio(a, b) <= 100.0


def test_sorted_name_score_column(spark):
    df = spark.createDataFrame([("JOHN A DOE", "DOE JOHN A"), ("JOHN DOE", "JON DOE")], "a string, b string")
    score = sorted_name_score(token_sort(F.col("a")), token_sort(F.col("b")))
    assert [round(r.s, 4) for r in df.select(score.alias("s")).collect()] == [100.0, 93.3333]


def test_two_decimals_like_a_c_library(spark):
    import random

    from tallyframe.functions.text import fixed_two

    rng = random.Random(4)
    values = [0.125, 0.375, 2.675, 1.005, 1e15 + 0.5, 0.005, 0.015, 0.045, 0.995, 0.9951, 99.995, -2.675, -0.001, -0.0, 0.0, 1e-300,
              8999999999999998.5, 4503599627370495.5, 0.285, 1.285, 5e-324, 123456789.125, 0.1 + 0.2, 1e14 + 0.125]
    values += [rng.randint(-10**6, 10**6) / 1000 for _ in range(3000)] + [rng.random() * 10 ** rng.randint(-4, 9) for _ in range(3000)]
    values += [(2 * rng.randint(0, 10**9) + 1) / 8 for _ in range(500)]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", F.expr(fixed_two("x")).alias("t")).collect()
    assert [(r.x, r.t) for r in got if r.t != f"{r.x:.2f}"] == []
    odd = spark.sql(f"SELECT {fixed_two('CAST(NULL AS DOUBLE)')} AS a, {fixed_two('1e22D')} AS b").first()
    assert odd.b == "10000000000000000000000.00"
