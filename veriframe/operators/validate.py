"""Findings of an agent held against the text that they cite."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grounding import digits, figure_retrievable, quote_retrievable, relevant, squeezed
from ..functions.normalize import parse_period, parse_quantity
from ..types import FIGURE_FINDING, FINDING, QUANTITY, STATUSES
from .retrieve import evidence_only

REQUIRED = ("claim_index", "verdict", "quote", "doc_id", "node_ids")
#: Fixed: the unit statement of a table.
TABLE_UNIT = r"(?i)\(in (thousands|millions|billions)[^)]*\)"
# What a result says where its evidence doesn't hold.
NO_FINDING = "agent returned no finding for this claim"
_JSON = json.JSONDecoder()


def _findings(content: str | None) -> list[str]:
    """The findings of a model's answer, each as JSON.

    An answer is read from its first object on, whatever follows it; where that
    object is broken, the array named findings is read in the same way.
    """
    answer = (content or "").partition("</think>")[2] or content or ""
    whole = re.search(r"\{", answer)
    part = re.search(r'"findings"[^\[]*(?=\[)', answer)
    for begin in (whole and whole.start(), part and part.end()):
        if begin is None:
            continue
        try:
            value, _ = _JSON.raw_decode(answer, begin)
        except json.JSONDecodeError:
            continue
        listed = value.get("findings") if isinstance(value, dict) else value
        return [json.dumps(x) for x in listed if isinstance(x, dict)] if isinstance(listed, list) else []
    return []


def decode_findings(answers: DataFrame) -> DataFrame:
    """(run, pos, finding): the findings in order, as JSON, of the answers (run, content)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_findings(x) for x in batch.column(1).to_pylist()], pa.list_(pa.string()))], names=["run", "findings"])

    lists = answers.select(F.col("run").cast("string").alias("run"), "content").mapInArrow(run, "run string, findings array<string>")
    return lists.select("run", F.posexplode("findings").alias("pos", "finding"))


def strip_answer(content: Column) -> Column:
    """What stands between the first and the last brace, after a model's thoughts."""
    tail = F.when(content.contains("</think>"), F.substring_index(content, "</think>", -1)).otherwise(content)
    return F.regexp_extract(tail, r"(?s)\{.*\}", 0)


def parse_findings(decoded: DataFrame) -> DataFrame:
    """(run, claim_index, finding fields, keys), the last finding of each claim."""
    parsed = decoded.select("run", "pos", F.from_json("finding", FINDING).alias("f"), F.json_object_keys("finding").alias("keys"))
    last = F.row_number().over(Window.partitionBy("run", "claim_index").orderBy(F.desc("pos")))
    return parsed.select("run", "pos", "keys", "f.*").withColumn("_last", last).filter("_last = 1").drop("_last", "pos")


def gathered(rows: DataFrame) -> DataFrame:
    """(request, content, titles, cite, unit): a request's rows as one, in order; the citation is the first row's."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "content", "title", "cite")))
    return rows.groupBy("request").agg(ordered.alias("r")).select(
        "request",
        F.array_join(F.transform("r", lambda x: F.coalesce(x["content"], F.lit(""))), " ").alias("content"),
        F.array_join(F.transform("r", lambda x: F.coalesce(x["title"], F.lit(""))), " ").alias("titles"),
        F.coalesce(F.get("r", F.lit(0))["cite"], F.lit("")).alias("cite"),
        F.coalesce(F.get(F.filter(F.transform("r", lambda x: F.regexp_extract(F.coalesce(x["content"], F.lit("")), TABLE_UNIT, 0)), lambda u: u != ""), F.lit(0)), F.lit("")).alias("unit"),
    )


def validate_all(claims: DataFrame, findings: DataFrame, fetched: DataFrame) -> DataFrame:
    """A result for every claim (run, claim_index, text) from findings and what was fetched for them.

    ``fetched`` is ``gathered`` rows with run and claim_index.  A finding whose
    evidence doesn't hold is NO_EVIDENCE with the reason in ``rejected``.
    """
    key = ["run", "claim_index"]
    joined = claims.join(findings, key, "left").join(fetched.select(*key, "content", "titles", "cite").withColumn("_rows", F.lit(True)), key, "left")
    verdict = F.upper(F.trim(F.coalesce("verdict", F.lit(""))))
    missing = F.filter(F.array(*(F.lit(k) for k in REQUIRED)), lambda k: ~F.array_contains("keys", k))
    absent = verdict.isin("NO_SOURCE", "NO_EVIDENCE")
    found, quote = F.coalesce("found", F.lit("")), F.coalesce("quote", F.lit(""))
    has_digits = digits(found) != ""
    rejected = (  # fixed texts
        F.when(F.col("keys").isNull(), NO_FINDING)
        .when(F.size(missing) > 0, F.concat(F.lit("missing required fields: "), F.array_join(missing, ", ")))
        .when(~verdict.isin(*STATUSES), F.concat(F.lit("verdict is not one of the known: "), verdict))
        .when(absent, "")
        .when(F.col("_rows").isNull(), F.concat(F.lit("cited node not retrievable: "), F.coalesce("doc_id", F.lit(""))))
        .when(has_digits & ~figure_retrievable(found, digits(F.col("content"))), F.concat(F.lit("figure is not in the cited text: "), found))
        .when(~has_digits & ~quote_retrievable(quote, squeezed(F.col("content"))), F.concat(F.lit("quote is not in the cited text: "), F.substring(quote, 1, 60)))
        .otherwise("")
    )
    good = F.col("rejected") == ""
    about = relevant(F.col("text"), quote, found, F.col("titles"))
    return joined.withColumn("rejected", rejected).select(
        *key,
        F.when(good, verdict).otherwise("NO_EVIDENCE").alias("status"),
        "claimed", "found", "resolved", "basis",
        F.when(good, F.col("reasoning")).otherwise(F.col("rejected")).alias("reason"),
        "quote", "doc_id", "node_ids",
        F.when(good & ~absent, F.col("cite")).otherwise("").alias("cite"),
        F.when(good & ~absent & ~about, F.array(F.lit("evidence may not relate to this claim"))).otherwise(F.array().cast("array<string>")).alias("warnings"),
        "rejected",
    )


def parse_figure_findings(decoded: DataFrame) -> DataFrame:
    """(run, claim_index, figures, doc_id, node_ids, quote), the last finding of each claim."""
    parsed = decoded.select("run", "pos", F.from_json("finding", FIGURE_FINDING).alias("f"))
    last = F.row_number().over(Window.partitionBy("run", "claim_index").orderBy(F.desc("pos")))
    return parsed.select("run", "pos", "f.*").withColumn("_last", last).filter("_last = 1").drop("_last", "pos")


def to_evidence(claims: DataFrame, findings: DataFrame, fetched: DataFrame, whole_numbers: bool = False, listing: DataFrame | None = None) -> DataFrame:
    """Evidence for every claim: the grounded figures of its finding as quantities, in order.

    Scale comes from the finding's unit, else from the unit statement of what was
    fetched; the period from the figure's own, else from figure and label.  With
    ``whole_numbers`` a figure must be a number of the text, not digits across numbers.
    With the ``listing`` of the corpus, findings that cite a deck, which can't prove itself, count as none.
    """
    key = ["run", "claim_index"]
    if listing is not None:
        findings = evidence_only(findings, listing)
    joined = claims.select(*key).join(findings, key, "left").join(fetched.select(*key, "content", "cite", "unit"), key, "left")
    text_digits = digits(F.coalesce("content", F.lit("")))
    numbers = F.transform(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"\d[\d,.]*"), F.lit(0)), digits) if whole_numbers else None
    figures = F.coalesce("figures", F.array().cast("array<struct<raw:string,label:string,unit:string,period:string>>"))
    held = lambda x: F.coalesce(F.col("content").isNotNull() & (F.coalesce(x["raw"], F.lit("")) != "") & figure_retrievable(x["raw"], text_digits, numbers), F.lit(False))

    def quantity(x: Column) -> Column:
        unit = F.when(F.coalesce(x["unit"], F.lit("")) != "", x["unit"]).otherwise(F.coalesce(F.col("unit"), F.lit("")))
        return parse_quantity(x["raw"], table_unit=unit, period=parse_period(x["period"]), context=F.coalesce(x["label"], F.lit("")))

    quantities = F.filter(F.transform(F.filter(figures, held), quantity), lambda q: q.isNotNull())
    dropped = F.transform(F.filter(figures, lambda x: ~held(x)), lambda x: F.coalesce(x["raw"], F.lit("")))
    quote = F.coalesce("quote", F.lit(""))
    bad_quote = (quote != "") & (F.size(figures) == 0) & ~F.coalesce(quote_retrievable(quote, squeezed(F.col("content"))), F.lit(False))
    lost = F.when(bad_quote, F.concat(dropped, F.array(F.concat(F.lit("quote not in cited text: "), F.substring(quote, 1, 60))))).otherwise(dropped)
    kept_quote = F.when(bad_quote, "").otherwise(quote)
    noted = F.when(F.size(lost) > 0, F.trim(F.concat(F.lit("[dropped, not present in the cited text: "), F.array_join(lost, ", "), F.lit("] "), kept_quote))).otherwise(kept_quote)
    staged = joined.withColumn("quantities", quantities.cast(f"array<{QUANTITY}>"))
    periods = F.filter(F.transform("quantities", lambda q: q["period"]), lambda p: p.isNotNull())
    return staged.select(*key, "quantities", periods.alias("covered_periods"), F.coalesce("doc_id", F.lit("")).alias("doc_id"), F.coalesce("node_ids", F.array().cast("array<string>")).alias("node_ids"), F.coalesce("cite", F.lit("")).alias("citation_url"), noted.alias("quote"))
