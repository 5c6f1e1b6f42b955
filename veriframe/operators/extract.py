"""Claims out of tagged rows or plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import NUMBER, detect_basis, parse_period, parse_quantity, plain_spaces, tagged_quantity

#: Fixed: a figure in running text, with its sign, currency and scale.
FIGURE = r"\$?\(?\$?" + NUMBER + r"\)?(?:\s*(?:%|percent|bps|basis points|[kmbt]n?\b|thousand|million|billion|trillion))?"
GROUP_SIZE = 10


def claim_key(text: Column) -> Column:
    """Lower case with single spaces."""
    return F.trim(F.regexp_replace(F.lower(plain_spaces(text)), r"\s+", " "))


def first_wins(rows: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each key, by ``order``; of rows that are equal there any one.

    Keys are told apart by two 64-bit hashes.  Only these and the order meet in the
    groups, a row of each task for each key; then the rows are filtered, so a large group of copies isn't gathered.
    """
    hashed = {"_a": F.xxhash64(F.lit(0), key), "_b": F.xxhash64(F.lit(1), key)}
    keyed = rows.select("*", *(h.alias(n) for n, h in hashed.items()), F.struct(*order).alias("_at"))
    first = keyed.groupBy("_a", "_b").agg(F.min("_at").alias("_at"))
    return keyed.join(first, ["_a", "_b", "_at"], "left_semi").dropDuplicates(["_a", "_b"]).select(*(F.col(f"`{c}`") for c in rows.columns))


def claims_from_tags(tagged: DataFrame) -> DataFrame:
    """Claims from an extractor's rows (pos and the tagged fields).

    Repeated texts go first, then entity claims and figures without a number; an
    unknown operation is absolute; the period is the row's, the section's or the figure's.
    """
    distinct = first_wins(tagged, claim_key(F.col("text")), "pos").filter(F.coalesce(F.col("operation"), F.lit("")) != "entity")
    parsed = distinct.withColumn("_parsed", parse_quantity(F.col("figure"))).filter("_parsed is not null")
    value = F.coalesce(tagged_quantity(F.col("value"), F.col("scale"), F.col("unit"), F.col("period"), F.col("text"), F.col("figure")), F.col("_parsed"))
    return parsed.withColumn("_q", value).select(
        F.col("pos").cast("bigint").alias("claim_id"),
        "text",
        F.col("_q").alias("value"),
        F.when(F.col("operation").isin("absolute", "growth", "margin"), F.col("operation")).otherwise("absolute").alias("operation"),
        F.coalesce(parse_period(F.col("period")), parse_period(F.col("section")), F.col("_q.period")).alias("period"),
        F.col("_q.basis").alias("basis"),
    )


def tag_text(lines: DataFrame) -> DataFrame:
    """Tagged rows from plain lines (doc_id, line_no, text): one for each figure of each sentence.

    It stands in for a model: growth and margin go by their words, and the section is the last heading.
    """
    heading = F.when(F.col("text").rlike("^#"), F.regexp_replace("text", "^#+\\s*", ""))
    section = F.last(heading, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("line_no"))
    sentences = lines.withColumn("section", section).filter(~F.col("text").rlike("^#")).select("doc_id", "line_no", "section", F.posexplode(F.split("text", r"(?<=[.!?])\s+", -1)).alias("s", "sentence"))
    figures = sentences.select("*", F.posexplode(F.regexp_extract_all("sentence", F.lit("(?i)" + FIGURE), F.lit(0))).alias("f", "figure"))
    low = F.lower("sentence")
    operation = F.when(low.rlike(r"\b(grew|growth|increase[ds]?|year over year|yoy)\b") & F.col("figure").rlike("%|percent"), "growth").when(low.rlike(r"\bmargin\b") & F.col("figure").rlike("%|percent"), "margin").otherwise("absolute")
    return figures.select("doc_id", "line_no", "s", "f", F.trim("sentence").alias("text"), F.trim("figure").alias("figure"), operation.alias("operation"), F.coalesce("section", F.lit("")).alias("section"), detect_basis(F.col("sentence")).alias("basis"))


def in_groups(claims: DataFrame, *order: str, size: int = GROUP_SIZE, by: str | None = None, span: int = 1 << 20) -> DataFrame:
    """``claims`` with group_no: ``size`` of them in each group, in order, within each value of ``by``.

    Rows are numbered within ranges of ``span`` values of the first column of
    ``order``, a whole number, and the ranges' counts are added up, so that no task numbers more.
    """
    whole = [by] if by else []
    part = F.floor(F.col(order[0]) / span)
    ranged = claims.withColumn("_range", part)
    counts = ranged.groupBy(*whole, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*(whole or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = counts.select(*whole, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    keys = [*whole, "_range"]
    held, at = ranged.alias("c"), offsets.alias("o")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"c.{k}").eqNullSafe(F.col(f"o.{k}"))
    inside = Window.partitionBy(*(f"c.{k}" for k in keys)).orderBy(*(f"c.{o}" for o in order))
    number = F.row_number().over(inside) - 1 + F.col("o._offset")
    return held.join(at, on).select(*(F.col(f"c.`{c}`") for c in claims.columns), F.floor(number / size).alias("group_no"))


def requested(claims: DataFrame, most: int) -> DataFrame:
    """The first claims of a request (request, pos, ...) whose figures have a number, out of its first ``most``."""
    first = claims.filter(F.col("pos") < most).withColumn("value", parse_quantity(F.col("figure")))
    return first.filter("value is not null")
