"""Text to numbers, units, scales, periods and accounting bases, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import PERIOD, QUANTITY

# Patterns and word lists that decide results.
NUMBER = r"[-+]?\d[\d,]*(?:\.\d+)?"
SCALE_SUFFIX = r"(?i)^\s*(k|mm|m|bn|b|t|thousands?|millions?|billions?|trillions?)\b"
TABLE_UNIT = r"(?i)in\s+(thousands?|millions?|billions?)"
BASIS_POINTS = r"(?i)^\s*(bps|basis\s+points?)\b"
PERCENT = r"(?i)^(\s*%|\s*percent)"
NEGATIVE = r"\(\s*\$?\s*\d[\d,.]*[^)]*\)"
MONTHS_ENDED = r"(?i)(one|two|three|six|nine|twelve|\d+)\s+months?\s+ended\s+([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})"
QUARTER = r"(?i)\bQ([1-4])\s*(?:of\s*)?(?:FY|fiscal\s*(?:year\s*)?)?\s*(\d{4}|\d{2})\b"
FISCAL_YEAR = r"(?i)\b(?:FY|fiscal\s*(?:year\s*)?)\s*(\d{4}|\d{2})\b"
FULL_YEAR = r"(?i)\b(?:full\s+year|year\s+ended[^,]*,?)\s*(\d{4})\b"
BASIS_MARKERS = (
    ("ARR", r"(?i)\bARR\b|annual(?:ized)?\s+recurring\s+revenue"),
    ("product revenue", r"(?i)\bproduct\s+revenue\b"),
    ("adjusted", r"(?i)\badjusted\b|\bEBITDA\b|\bpro\s*forma\b"),
    ("non-GAAP", r"(?i)non[-\s]?GAAP"),
    ("GAAP", r"(?i)\bGAAP\b|\btotal\s+revenue\b|\brevenue\b"),
)
SCALE_WORDS = {"k": 1e3, "thousand": 1e3, "m": 1e6, "mm": 1e6, "million": 1e6, "b": 1e9, "bn": 1e9, "billion": 1e9, "t": 1e12, "trillion": 1e12}
#: Fixed: white space beside the ASCII kind; all of it counts as a space.
OTHER_SPACES = "\u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
TAG_SCALES = {"": 1.0, "K": 1e3, "M": 1e6, "B": 1e9, "T": 1e12}
MONTH_COUNTS = {"one": 1, "two": 2, "three": 3, "six": 6, "nine": 9, "twelve": 12}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def _lookup(key: Column, table: dict) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once however often it stands in the result."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def plain_spaces(text: Column) -> Column:
    """The text, empty if null, with every other white space as a plain space: filings are full of non-breaking ones."""
    return F.translate(F.coalesce(text, F.lit("")), OTHER_SPACES, " " * len(OTHER_SPACES))


_text = plain_spaces


def detect_basis(text: Column) -> Column:
    """The first basis, in the fixed order, whose marker stands in the text."""
    found = F.lit("unknown")
    for basis, pattern in reversed(BASIS_MARKERS):
        found = F.when(_text(text).rlike(pattern), basis).otherwise(found)
    return found


def scale_of_word(word: Column) -> Column:
    """The multiplier of k, mm, bn, thousands and the like; null for other words."""
    return _lookup(F.regexp_replace(F.lower(word), "^(thousand|million|billion|trillion)s$", "$1"), SCALE_WORDS)


def parse_table_scale(text: Column) -> Column:
    """The multiplier of a table's unit statement such as "(in thousands)", else 1."""
    return F.coalesce(scale_of_word(F.regexp_extract(_text(text), TABLE_UNIT, 1)), F.lit(1.0))


def full_year(digits: Column) -> Column:
    """Years of two digits are in the 2000s."""
    n = digits.try_cast("int")
    return F.when(n < 100, n + 2000).otherwise(n)


def _period(kind: str, label: Column, year: Column, quarter: Column | None = None, months: Column | None = None, end: Column | None = None) -> Column:
    null = F.lit(None)
    return F.struct(
        F.lit(kind).alias("kind"),
        year.cast("int").alias("year"),
        (null if quarter is None else quarter).cast("int").alias("quarter"),
        (null if months is None else months).cast("int").alias("months"),
        (null if end is None else end).cast("date").alias("end_date"),
        label.alias("label"),
    ).cast(PERIOD)


def parse_period(text: Column) -> Column:
    """The fiscal period that a text names, by the first form that fits, or null."""
    return let(_text(text), _parse_period)


def _parse_period(t: Column) -> Column:
    part = lambda pattern, i: F.regexp_extract(t, pattern, i)
    month = F.array_position(F.array(*(F.lit(m) for m in MONTHS)), F.lower(part(MONTHS_ENDED, 2)))
    date = F.concat_ws("-", part(MONTHS_ENDED, 4), F.lpad(month.cast("string"), 2, "0"), F.lpad(part(MONTHS_ENDED, 3), 2, "0")).try_cast("date")
    word = F.lower(part(MONTHS_ENDED, 1))
    months = F.coalesce(_lookup(word, MONTH_COUNTS), word.try_cast("int"))
    ended = F.when(date.isNotNull(), _period("months_ended", part(MONTHS_ENDED, 0), F.year(date), months=months, end=date))
    return (
        F.when(t.rlike(MONTHS_ENDED) & (month > 0), ended)
        .when(t.rlike(QUARTER), _period("Q", part(QUARTER, 0), full_year(part(QUARTER, 2)), quarter=part(QUARTER, 1).try_cast("int")))
        .when(t.rlike(FISCAL_YEAR), _period("FY", part(FISCAL_YEAR, 0), full_year(part(FISCAL_YEAR, 1))))
        .when(t.rlike(FULL_YEAR), _period("FY", part(FULL_YEAR, 0), part(FULL_YEAR, 1).try_cast("int")))
    )


def periods_match(a: Column, b: Column) -> Column:
    """True where either is null; end dates and months decide where both have them, else kind, year and quarter."""
    dated = a["end_date"].isNotNull() & b["end_date"].isNotNull()
    by_date = (a["end_date"] == b["end_date"]) & a["months"].eqNullSafe(b["months"])
    by_name = a["kind"].eqNullSafe(b["kind"]) & a["year"].eqNullSafe(b["year"]) & a["quarter"].eqNullSafe(b["quarter"])
    return a.isNull() | b.isNull() | F.when(dated, by_date).otherwise(by_name)


def _six(x: Column) -> Column:
    """struct(digits, e): x rounded to six significant digits, and its exponent."""
    rounded = let(F.floor(F.log10(F.abs(x))), lambda e: F.struct(F.round(F.abs(x) / F.pow(F.lit(10.0), e - 5)).cast("bigint").alias("six"), e.alias("e")))
    over = lambda r: r["six"] >= 1_000_000
    return let(rounded, lambda r: F.struct(F.when(over(r), F.lit("100000")).otherwise(r["six"].cast("string")).alias("digits"), F.when(over(r), r["e"] + 1).otherwise(r["e"]).cast("int").alias("e")))


def short_number(x: Column, commas: bool = False) -> Column:
    """x with up to six significant digits, without trailing zeros, and in powers of ten when very large or small."""
    return let(x, lambda v: let(_six(v), lambda six: _shown(v, six["digits"], six["e"], commas)))


def _shown(x: Column, digits: Column, e: Column, commas: bool) -> Column:
    sign = F.when(x < 0, "-").otherwise("")
    dot = lambda whole, rest: F.concat(whole, F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""))
    trimmed = lambda s: F.regexp_replace(s, "0+$", "")
    whole = F.substring(digits, F.lit(1), e + 1)
    if commas:
        whole = F.regexp_replace(whole, r"(?<=\d)(?=(\d{3})+$)", ",")
    plain = dot(whole, trimmed(F.substring(digits, e + 2, F.lit(6))))
    small = dot(F.lit("0"), trimmed(F.concat(F.repeat(F.lit("0"), -e - 1), digits)))
    power = F.concat(dot(F.substring(digits, 1, 1), trimmed(F.substring(digits, 2, 5))), F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.lpad(F.abs(e).cast("string"), 2, "0"))
    return F.when(x == 0, "0").otherwise(F.concat(sign, F.when((e < -4) | (e >= 6), power).when(e < 0, small).otherwise(plain)))


def _number(text: Column) -> Column:
    return F.regexp_extract(text, NUMBER, 0)


def parse_quantity(text: Column, table_unit: Column | str = "", period: Column | None = None, context: Column | str = "") -> Column:
    """The first number of a text as a quantity, or null where there is none.

    A scale in the text wins over the table's; a parenthesised number anywhere
    makes it negative; ``context`` helps to find period and basis only.
    """
    table_unit = F.lit(table_unit) if isinstance(table_unit, str) else table_unit
    context = F.lit(context) if isinstance(context, str) else context

    def cut(t: Column) -> Column:
        return F.struct(t.alias("t"), _number(t).alias("number"), F.regexp_extract(t, rf"(?s)^.*?(?:{NUMBER})(.*)$", 1).alias("tail"), F.concat(t, F.lit(" "), _text(context)).alias("both"))

    return let(let(F.regexp_replace(_text(text), r"^\s+|\s+$", ""), cut), lambda p: _quantity(p["t"], p["number"], p["tail"], p["both"], table_unit, period))


def _quantity(t: Column, number: Column, tail: Column, both: Column, table_unit: Column, period: Column | None) -> Column:
    plain = F.regexp_replace(number, ",", "").try_cast("double")
    bps, percent = tail.rlike(BASIS_POINTS), tail.rlike(PERCENT)
    suffix = F.regexp_extract(tail, SCALE_SUFFIX, 1)
    value = F.when(bps, plain / 100.0).otherwise(plain)
    unit = F.when(bps | percent, "percent").when(t.contains("$"), "USD").otherwise("count")
    scale = F.when(bps | percent, 1.0).when(suffix != "", scale_of_word(suffix)).otherwise(parse_table_scale(table_unit))
    found = parse_period(both) if period is None else F.coalesce(period, parse_period(both))
    quantity = F.struct(
        F.when(t.rlike(NEGATIVE), -value).otherwise(value).alias("value"),
        unit.alias("unit"),
        scale.alias("scale"),
        found.alias("period"),
        detect_basis(both).alias("basis"),
        F.when(bps, short_number(plain / 100.0)).otherwise(number).alias("raw"),
    ).cast(QUANTITY)
    return F.when(plain.isNotNull(), quantity)


def base_value(quantity: Column) -> Column:
    return quantity["value"] * quantity["scale"]


def significant_figures(raw: Column) -> Column:
    """Significant figures of a number as written; end zeros of an integer don't count."""
    return let(F.regexp_replace(_text(raw), r"[^\d.]", ""), _figures)


def _figures(s: Column) -> Column:
    decimal = F.regexp_replace(F.regexp_replace(s, r"\.", ""), "^0+", "")
    whole = F.regexp_replace(s, "^0+|0+$", "")
    return F.when(s == "", 0).when(s.contains("."), F.greatest(F.length(decimal), F.lit(1))).otherwise(F.greatest(F.length(whole), F.lit(1)))


def tagged_quantity(value: Column, scale: Column, unit: Column, period: Column, text: Column, figure: Column) -> Column:
    """A quantity from an extractor's tags, or null where the value or the scale tag is unusable."""
    number, factor = value.try_cast("double"), _lookup(F.upper(F.trim(_text(scale))), TAG_SCALES)
    known = F.when(F.coalesce(F.nullif(unit, F.lit("")), F.lit("count")).isin("USD", "percent", "count", "ratio"), F.coalesce(F.nullif(unit, F.lit("")), F.lit("count"))).otherwise("count")
    q = F.struct(number.alias("value"), known.alias("unit"), factor.alias("scale"), parse_period(period).alias("period"), detect_basis(text).alias("basis"), F.coalesce(F.nullif(figure, F.lit("")), number.cast("string")).alias("raw")).cast(QUANTITY)
    return F.when(number.isNotNull() & factor.isNotNull(), q)
