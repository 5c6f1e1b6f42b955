import random

import pytest
from pyspark.sql import functions as F

from veriframe.operators import compare
from veriframe.types import CLAIMS, EVIDENCE, QUANTITY


def fy(year):
    return ("FY", year, None, None, None, f"FY{year}")


def q(value, unit="USD", scale=1.0, year=2024, basis="GAAP", raw=None):
    return (float(value), unit, float(scale), fy(year) if year else None, basis, raw or f"{value:g}")


def pct(value, **k):
    return q(value, unit="percent", **k)


def edges():
    """Claims of one to five digits, each with what lies just within half a unit of its last digit, and just beyond."""
    rng, out = random.Random(12), []
    for digits in range(1, 6):
        for scale in (1.0, 1e3, 1e6):
            whole = rng.randrange(10 ** (digits - 1) + 1, 10**digits)
            whole += whole % 10 == 0
            for side in (-1, 1):
                for share, status, code in ((0.49, "SUPPORTED", ""), (0.51, "CONTRADICTED", "band")):
                    actual = (whole + side * share) * scale
                    if 1 / 9.5 < whole * scale / actual < 9.5:
                        out.append((f"{whole} x {scale:g} {side * share:+}", q(whole, scale=scale, raw=str(whole)), "absolute", [q(actual)], (2024,), status, code))
    return out


#: label, claim value, operation, quantities, covered years, status, reason code
CASES = [
    *edges(),
    ("nine and a half times", q(19), "absolute", [q(2)], (2024,), "CONTRADICTED", "scale"),
    ("a thousandth", q(6.4, scale=1e3), "absolute", [q(6.4, scale=1e6)], (2024,), "CONTRADICTED", "scale"),
    ("older figure", q(380, scale=1e3), "absolute", [q(380_112, year=2021)], (2024, 2021), "CONTRADICTED", "period"),
    ("dollars for a share", pct(31), "absolute", [q(31)], (2024,), "CONTRADICTED", "unit"),
    ("figure without a unit", q(907, scale=1e3), "absolute", [q(0.9071, unit="count", scale=1e6)], (2024,), "SUPPORTED", ""),
    ("fall", pct(-15), "growth", [q(8_500), q(10_000, year=2023)], (2024,), "SUPPORTED", ""),
    ("fall told as rise", pct(15), "growth", [q(8_500), q(10_000, year=2023)], (2024,), "CONTRADICTED", "band"),
    ("part of a whole", pct(37), "margin", [q(3_741), q(10_000)], (2024,), "SUPPORTED", ""),
    ("no second figure", pct(37), "margin", [q(3_741)], (2024,), "NO_EVIDENCE", "not_enough"),
    ("grown from nothing", pct(37), "growth", [q(12), q(0)], (2024,), "NO_EVIDENCE", "not_enough"),
    ("fits the other basis", q(91, scale=1e3, basis="adjusted", raw="91"), "absolute", [q(77_300), q(91_200, basis="adjusted")], (2024,), "BASIS_MISMATCH", "basis"),
    ("fits neither basis", q(85, scale=1e3, basis="adjusted", raw="85"), "absolute", [q(77_300), q(91_200, basis="adjusted")], (2024,), "CONTRADICTED", "band"),
    ("fits the first basis", q(77, scale=1e3), "absolute", [q(77_300), q(91_200, basis="adjusted")], (2024,), "SUPPORTED", ""),
    ("no first basis", q(77, scale=1e3, basis="ARR"), "absolute", [q(0.0773, unit="count", scale=1e6, basis="ARR")], (2024,), "SUPPORTED", ""),
    ("bases don't mix", pct(50), "margin", [q(40, basis="adjusted"), q(80)], (2024,), "NO_EVIDENCE", "not_enough"),
    ("year that nothing covers", q(380, scale=1e3), "absolute", [q(380_112, year=2020)], (2020,), "NO_SOURCE", "not_covered"),
    ("covered, nothing found", q(380, scale=1e3), "absolute", [], (2024,), "NO_EVIDENCE", "no_quantities"),
    ("nothing at all", q(380, year=None), "absolute", [], (), "NO_SOURCE", "not_covered"),
    ("odd operation", q(380, scale=1e3), "tally", [q(380_112)], (2024,), "SUPPORTED", ""),
]


@pytest.fixture(scope="module")
def decided(spark):
    claims = [(i, c[0], c[1], c[2], None, "unknown") for i, c in enumerate(CASES)]
    evidence = [(i, c[3], [fy(y) for y in c[4]], "d", ["n1"], "", "") for i, c in enumerate(CASES)]
    out = compare.verdicts(spark.createDataFrame([*claims, (99, "no row", q(1), "absolute", None, None)], CLAIMS), spark.createDataFrame(evidence, EVIDENCE))
    return {r.claim_id: r for r in out.collect()}


def test_statuses(decided):
    assert [(c[0], decided[i].status, decided[i].reason_code) for i, c in enumerate(CASES)] == [(c[0], c[5], c[6]) for c in CASES]
    assert decided[99].status == "NO_SOURCE"


def test_figures_and_reasons(decided):
    by = {c[0]: decided[i] for i, c in enumerate(CASES)}
    assert by["a thousandth"].reason == f"scale mismatch: {6.4e3:,.6g} vs {6.4e6:,.6g}" and by["a thousandth"].actual == 6.4e6
    assert by["fall"].actual == pytest.approx(-15)
    other = by["fits the other basis"]
    assert (other.actual, other.actual_basis, other.claimed_basis) == (77_300, "adjusted", "adjusted")
    assert other.reason == f"claim matches adjusted ({91_200:,.6g}) but not GAAP ({77_300:,.6g})"
    assert by["older figure"].reason == "period mismatch: claim FY2024 vs evidence FY2021"
    assert by["dollars for a share"].reason == "unit mismatch: percent vs USD"
    assert by["covered, nothing found"].actual is None and by["no second figure"].reason == "not enough quantities to compute margin"


def test_bands(spark):
    bands = [(6.1, "6.1", 0.05), (6.1, "6.100", 0.0005), (3700.0, "3700", 50.0), (58.0, "58", 0.5), (903_771.0, "903,771", 0.5), (0.0, "0", 0.0), (30.0, "", 1.0)]
    got = spark.createDataFrame([b[:2] for b in bands], "v double, r string").select(compare.numeric_band(F.col("v"), F.col("r")).alias("b")).collect()
    assert [r.b for r in got][:-1] == [pytest.approx(b[2]) for b in bands[:-1]] and got[-1].b > 0


def test_compute(spark):
    row = spark.createDataFrame([([q(7), q(4)],)], f"qs array<{QUANTITY}>").select(compare.compute(F.lit("growth"), F.col("qs")).alias("g"), compare.compute(F.lit("margin"), F.col("qs")).alias("m"), compare.compute(F.lit("absolute"), F.array().cast(f"array<{QUANTITY}>")).alias("n")).first()
    assert row.g.value == pytest.approx(75) and row.g.unit == "percent" and row.m.value == pytest.approx(175) and row.n is None
