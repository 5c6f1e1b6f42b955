"""Claims against evidence: one of five verdicts by a fixed order of decisions.

Everything is a row-local expression over the ordered array of a claim's
quantities, so deciding claims needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import base_value, let, periods_match, short_number, significant_figures
from ..types import QUANTITY

# Fixed values of the decision rules.
BAND_ULPS = 0.5
RELATIVE_BAND = 0.005
SCALE_RATIO = 9.5
STATED_UNITS = ("USD", "percent", "ratio")
PRIMARY_ORDER = ("GAAP", "unknown")


def numeric_band(value: Column, raw: Column) -> Column:
    """Half a unit of the last significant digit of a figure as written."""

    def band(sig: Column) -> Column:
        exponent = F.floor(F.log10(F.abs(value))) - (sig - 1)
        return F.when((sig == 0) | (value == 0), F.abs(value) * RELATIVE_BAND).otherwise(F.pow(F.lit(10.0), exponent.cast("double")) * BAND_ULPS)

    return let(significant_figures(raw), band)


def within_tolerance(claimed: Column, actual: Column) -> Column:
    """struct(ok, code, reason): unit, period and scale are looked at before the band."""
    return let(mismatch(claimed, actual), lambda code: F.struct((code == "").alias("ok"), code.alias("code"), _reason(code, claimed, actual).alias("reason")))


def mismatch(claimed: Column, actual: Column) -> Column:
    """What keeps two figures apart: "unit", "period", "scale" or "band"; "" where nothing does."""
    c, a = base_value(claimed), base_value(actual)
    unit = claimed["unit"].isin(*STATED_UNITS) & actual["unit"].isin(*STATED_UNITS) & (claimed["unit"] != actual["unit"])
    period = ~periods_match(claimed["period"], actual["period"])
    ratio = F.try_divide(F.abs(c), F.abs(a))
    scale = (c != 0) & (a != 0) & ((ratio >= SCALE_RATIO) | (ratio <= 1 / SCALE_RATIO))
    inside = F.abs(c - a) <= _claim_band(claimed)
    return F.when(unit, "unit").when(period, "period").when(scale, "scale").when(inside, "").otherwise("band")


def _claim_band(claimed: Column) -> Column:
    return numeric_band(claimed["value"], claimed["raw"]) * claimed["scale"]


def _reason(code: Column, claimed: Column, actual: Column) -> Column:
    """What is said of a mismatch, in fixed words."""
    name = lambda p: F.coalesce(F.nullif(p["label"], F.lit("")), F.concat_ws(" ", p["kind"], p["year"].cast("string"), p["quarter"].cast("string")))
    figures = F.transform(F.array(base_value(claimed), base_value(actual), _claim_band(claimed)), lambda x: short_number(x, commas=True))

    def of_figures(shown: Column) -> Column:
        sides = F.concat(F.get(shown, F.lit(0)), F.lit(" vs "), F.get(shown, F.lit(1)))
        return F.when(code == "scale", F.concat(F.lit("scale mismatch: "), sides)).otherwise(F.concat(F.lit("outside band: "), sides, F.lit(" (+/-"), F.get(shown, F.lit(2)), F.lit(")")))

    return (
        F.when(code == "", "")
        .when(code == "unit", F.concat(F.lit("unit mismatch: "), claimed["unit"], F.lit(" vs "), actual["unit"]))
        .when(code == "period", F.concat(F.lit("period mismatch: claim "), name(claimed["period"]), F.lit(" vs evidence "), name(actual["period"])))
        .otherwise(let(figures, of_figures))
    )


def compute(operation: Column, quantities: Column) -> Column:
    """The figure that an operation gives over ordered quantities, or null where it can't."""
    first, second = F.get(quantities, F.lit(0)), F.get(quantities, F.lit(1))
    a, b = base_value(first), base_value(second)
    value = F.when(operation == "growth", F.try_divide(a - b, b) * 100.0).when(operation == "margin", F.try_divide(a, b) * 100.0)
    derived = F.struct(value.alias("value"), F.lit("percent").alias("unit"), F.lit(1.0).alias("scale"), first["period"].alias("period"), first["basis"].alias("basis"), short_number(value).alias("raw")).cast(QUANTITY)
    return F.when(operation == "absolute", first).when(value.isNotNull(), derived)


def covers(period: Column, covered: Column, quantities: Column) -> Column:
    """Whether evidence covers a period; a null period is covered by anything at all."""
    anything = (F.coalesce(F.size(covered), F.lit(0)) > 0) | (F.coalesce(F.size(quantities), F.lit(0)) > 0)
    return F.when(period.isNull(), anything).otherwise(F.coalesce(F.exists(covered, lambda p: periods_match(period, p)), F.lit(False)))


def claim_defaults(claims: DataFrame) -> DataFrame:
    """A claim without period or basis takes those of its value; an unknown operation is absolute."""
    return claims.withColumns(
        {
            "period": F.coalesce("period", F.col("value.period")),
            "basis": F.when(F.coalesce("basis", F.lit("unknown")) == "unknown", F.coalesce(F.col("value.basis"), F.lit("unknown"))).otherwise(F.col("basis")),
            "operation": F.when(F.col("operation").isin("absolute", "growth", "margin"), F.col("operation")).otherwise("absolute"),
        }
    )


def decide(joined: DataFrame) -> DataFrame:
    """Adds status, claimed, actual, claimed_basis, actual_basis, reason_code and reason to rows of claims with quantities and covered_periods."""
    q = F.coalesce("quantities", F.array().cast(f"array<{QUANTITY}>"))
    bases = F.array_distinct(F.transform(q, lambda x: x["basis"]))
    primary = F.get(bases, F.lit(0))
    for basis in reversed(PRIMARY_ORDER):
        primary = F.when(F.array_contains(bases, basis), basis).otherwise(primary)
    staged = joined.withColumns({"_q": q, "_bases": bases}).withColumn("_primary", primary)
    of_basis = lambda b: F.filter("_q", lambda x: x["basis"] == b)
    staged = staged.withColumn("_actual", compute(F.col("operation"), of_basis(F.col("_primary"))))
    staged = staged.withColumn("_check", within_tolerance(F.col("value"), F.col("_actual")))
    others = F.transform(F.filter("_bases", lambda b: b != F.col("_primary")), lambda b: F.struct(b.alias("basis"), compute(F.col("operation"), of_basis(b)).alias("figure")))
    fits = F.filter(others, lambda o: o["figure"].isNotNull() & (mismatch(F.col("value"), o["figure"]) == ""))
    staged = staged.withColumn("_alt", F.get(fits, F.lit(0)))
    uncovered = ~covers(F.col("period"), F.col("covered_periods"), F.col("_q"))
    empty, short, ok, alt = F.size("_q") == 0, F.col("_actual").isNull(), F.col("_check.ok"), F.col("_alt").isNotNull()
    actual = base_value(F.col("_actual"))
    decided = staged.withColumns(
        {
            "status": F.when(uncovered, "NO_SOURCE").when(empty | short, "NO_EVIDENCE").when(ok, "SUPPORTED").when(alt, "BASIS_MISMATCH").otherwise("CONTRADICTED"),
            "claimed": base_value(F.col("value")),
            "actual": F.when(~(uncovered | empty | short), actual),
            "claimed_basis": F.col("basis"),
            "actual_basis": F.when(uncovered | empty | short, F.lit(None)).when(ok, F.col("_actual.basis")).when(alt, F.col("_alt.basis")).otherwise(F.col("_actual.basis")),
            "reason_code": F.when(uncovered, "not_covered").when(empty, "no_quantities").when(short, "not_enough").when(ok, "").when(alt, "basis").otherwise(F.col("_check.code")),
            # fixed texts
            "reason": F.when(uncovered, "no document covers the claim's period")
            .when(empty, "no quantities retrieved")
            .when(short, F.concat(F.lit("not enough quantities to compute "), F.col("operation")))
            .when(ok, "")
            .when(alt, F.concat(F.lit("claim matches "), F.col("_alt.basis"), F.lit(" ("), short_number(base_value(F.col("_alt.figure")), commas=True), F.lit(") but not "), F.col("_primary"), F.lit(" ("), short_number(actual, commas=True), F.lit(")")))
            .otherwise(F.col("_check.reason")),
        }
    )
    return decided.drop("_q", "_bases", "_primary", "_actual", "_check", "_alt")


def verdicts(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """A verdict for every claim; claims without evidence rows count as having none."""
    slim = evidence.select("claim_id", "quantities", "covered_periods", "doc_id", "node_ids", "citation_url", "quote")
    return decide(claim_defaults(claims).join(slim, "claim_id", "left"))
