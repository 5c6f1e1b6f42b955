import datetime

import pytest
from pyspark.sql import functions as F

from veriframe.functions import normalize as nz

#: Fixed: the forms that must be read, and as what.
QUANTITIES = [
    ("$4.2M", "", 4.2, "USD", 1e6), ("$4.2 million", "", 4.2, "USD", 1e6), ("$4.2B", "", 4.2, "USD", 1e9), ("4,183,204", "", 4183204.0, "count", 1.0),
    ("$4,183,204", "", 4183204.0, "USD", 1.0), ("(1,978)", "", -1978.0, "count", 1.0), ("$(1,978)", "(in thousands)", -1978.0, "USD", 1e3), ("2,806", "(in thousands)", 2806.0, "count", 1e3),
    ("2,806", "(in millions)", 2806.0, "count", 1e6), ("$4.2M", "(in thousands)", 4.2, "USD", 1e6), ("72%", "", 72.0, "percent", 1.0), ("72 percent", "", 72.0, "percent", 1.0),
    ("140 bps", "", 1.4, "percent", 1.0), ("140 basis points", "", 1.4, "percent", 1.0), ("-3.5%", "", -3.5, "percent", 1.0),
    ("FY2024 revenue $4.2M", "", 2024.0, "USD", 1.0), ("$54 million (2% margin)", "", -54.0, "USD", 1e6), ("72 percentile", "", 72.0, "percent", 1.0), ("4.2 months", "", 4.2, "count", 1.0),
]


def test_quantities(spark):
    df = spark.createDataFrame([(t, u) for t, u, *_ in QUANTITIES], "t string, u string").select(nz.parse_quantity(F.col("t"), table_unit=F.col("u")).alias("q"))
    assert [(r.q.value, r.q.unit, r.q.scale) for r in df.collect()] == [(pytest.approx(v), unit, s) for *_, v, unit, s in QUANTITIES]
    assert [r.q for r in spark.createDataFrame([("",), (None,), ("market-leading platform",)], "t string").select(nz.parse_quantity(F.col("t")).alias("q")).collect()] == [None] * 3


def test_context_and_raw(spark):
    q = spark.createDataFrame([("$4.2M",)], "t string").select(nz.parse_quantity(F.col("t"), context="Total revenue for FY2024").alias("q"), nz.parse_quantity(F.lit("140 bps")).alias("b")).first()
    assert (q.q.period.kind, q.q.period.year, q.q.basis, q.q.raw, q.b.raw) == ("FY", 2024, "GAAP", "4.2", "1.4")


#: Fixed, as above.
PERIODS = {
    "FY2024": ("FY", 2024, None, None, None), "fiscal 2024": ("FY", 2024, None, None, None), "fiscal year 2023": ("FY", 2023, None, None, None), "FY24": ("FY", 2024, None, None, None),
    "Q4 2023": ("Q", 2023, 4, None, None), "Q4 FY2024": ("Q", 2024, 4, None, None), "three months ended October 31, 2023": ("months_ended", 2023, None, 3, datetime.date(2023, 10, 31)),
    "nine months ended January 31, 2024": ("months_ended", 2024, None, 9, datetime.date(2024, 1, 31)), "full year 2022": ("FY", 2022, None, None, None),
    "Revenue grew": None, "2024": None, "December 31, 2024": None, "Three Months Ended Sep 30, 2024": None, "six months ended February 30, 2024": None, "": None,
}


def test_periods(spark):
    got = spark.createDataFrame([(t,) for t in PERIODS], "t string").select("t", nz.parse_period(F.col("t")).alias("p")).collect()
    assert {r.t: r.p and (r.p.kind, r.p.year, r.p.quarter, r.p.months, r.p.end_date) for r in got} == PERIODS


def test_period_matching(spark):
    pairs = [("FY2024", "fiscal 2024", True), ("FY2024", "FY2023", False), ("Q4 2023", "FY2023", False), ("FY2024", "", True), ("Q3 2024", "three months ended September 30, 2024", False)]
    got = spark.createDataFrame([p[:2] for p in pairs], "a string, b string").select(nz.periods_match(nz.parse_period(F.col("a")), nz.parse_period(F.col("b"))).alias("m")).collect()
    assert [r.m for r in got] == [p[2] for p in pairs]


#: Fixed, as above.
BASES = {"ARR of $3.0B": "ARR", "annual recurring revenue": "ARR", "product revenue of $2.6B": "product revenue", "adjusted EBITDA margin": "adjusted", "non-GAAP operating income": "non-GAAP", "total revenue": "GAAP", "headcount grew to 7,000": "unknown"}


def test_basis_scale_and_figures(spark):
    got = spark.createDataFrame([(t,) for t in BASES], "t string").select("t", nz.detect_basis(F.col("t")).alias("b")).collect()
    assert {r.t: r.b for r in got} == BASES
    scales = {"(in thousands)": 1e3, "(in millions, except per share data)": 1e6, "(in billions)": 1e9, "": 1.0, "Statements of Operations": 1.0}
    assert {r.t: r.s for r in spark.createDataFrame([(t,) for t in scales], "t string").select("t", nz.parse_table_scale(F.col("t")).alias("s")).collect()} == scales
    sig = {"4.2": 2, "4.20": 3, "140": 2, "72": 2, "4,183,204": 7, "0.045": 2, "100": 1, "$4.2M": 2, "": 0, "0": 1}
    assert {r.t: r.s for r in spark.createDataFrame([(t,) for t in sig], "t string").select("t", nz.significant_figures(F.col("t")).alias("s")).collect()} == sig


def test_short_numbers(spark):
    xs = [0.0, 1.4, 2.0, 1234567.0, 4183204.0, 54284.0, 999999.5, 0.00012345, 0.000012345, -2684275000.0, 41.8654321, 1e21]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", nz.short_number(F.col("x")).alias("g"), nz.short_number(F.col("x"), commas=True).alias("c")).collect()
    assert [(r.g, r.c) for r in got] == [(format(x, "g"), format(x, ",.6g")) for x in xs]


def test_non_breaking_spaces(spark):
    texts = ["$4.2 million", "three months ended October 31, 2023", "total  revenue", "140 bps", "(in thousands)"]
    t = F.translate(F.col("t"), " ", "\u00a0")
    got = spark.createDataFrame([(x,) for x in texts], "t string").select(nz.parse_quantity(t).alias("q"), nz.parse_period(t).alias("p"), nz.detect_basis(t).alias("b"), nz.parse_table_scale(t).alias("s")).collect()
    assert (got[0].q.value, got[0].q.scale) == (4.2, 1e6) and (got[1].p.months, got[1].p.end_date) == (3, datetime.date(2023, 10, 31))
    assert got[2].b == "GAAP" and (got[3].q.value, got[3].q.unit) == (1.4, "percent") and got[4].s == 1e3
