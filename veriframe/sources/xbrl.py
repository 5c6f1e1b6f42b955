"""Tagged facts of inline XBRL pages as a table, beside the text of the same pages.

A task reads a page tag by tag and keeps the open tags; what a fact means is
decided in Spark: its number, sign, scale and format become a quantity, its
context a period and dimensions, and of several tellings of one fact the most
precise one counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import PERIOD, QUANTITY
from .html_tokens import attributes, tokens

# Fixed values of the format, tags in lower case: tagged numbers and texts, and what a context and a unit consist of.
NUMBER, TEXT = "ix:nonfraction", "ix:nonnumeric"
CONTEXT, UNIT = "context", "unit"
DATES = {"startdate": "start", "enddate": "end", "instant": "instant"}
MEMBERS = ("explicitmember", "typedmember")
#: A tagged number has no more characters than this; longer ones hold no number.
MOST_DIGITS = 200
#: Fixed: concepts of these vocabularies follow accounting rules.
GAAP_VOCABULARIES = ("us-gaap", "ifrs-full")

CONTEXT_TYPE = "struct<start:string,end:string,instant:string,dims:map<string,string>>"
FACT_TYPE = "struct<seq:int,concept:string,context:string,unit:string,text:string,scale:string,decimals:string,sign:string,format:string,nil:boolean>"
_FIELDS = [("seq", pa.int32()), *((n, pa.string()) for n in ("concept", "context", "unit", "text", "scale", "decimals", "sign", "format")), ("nil", pa.bool_())]
_FACTS = pa.list_(pa.struct(_FIELDS))
_CONTEXTS = pa.map_(pa.string(), pa.struct([("start", pa.string()), ("end", pa.string()), ("instant", pa.string()), ("dims", pa.map_(pa.string(), pa.string()))]))
_UNITS = pa.map_(pa.string(), pa.string())


def tagged(html: str) -> tuple[list[dict], dict[str, dict], dict[str, str]]:
    """(facts, contexts by id, units by id) of a page, in one pass; of equal ids the first counts.

    A fact's text is all text up to its end tag, that of facts within it included; texts too long for a number stay empty.
    """
    facts: list[dict] = []
    contexts: dict[str, dict] = {}
    units: dict[str, str] = {}
    texts: list[str] = []
    sizes = [0]  # characters of all texts so far
    open_facts: list[tuple[str, dict, int]] = []
    context: dict | None = None
    unit: list[str] | None = None
    holds: tuple[str, str] | None = None  # what the next texts say of the open context or unit
    for kind, what, written in tokens(html):
        if kind == "text":
            text = unescape(what)
            if holds and context is not None and holds[0] in ("start", "end", "instant"):
                context[holds[0]] = (context[holds[0]] or "") + text.strip()
            elif holds and context is not None:
                context["dims"][holds[1]] = context["dims"].get(holds[1], "") + text.strip()
            elif holds and unit is not None:
                unit.append(text.strip())
            if open_facts:
                texts.append(text)
                sizes.append(sizes[-1] + len(text))
            continue
        local = what.rpartition(":")[2]
        if kind == "start":
            own = attributes(written)
            if what in (NUMBER, TEXT):
                fact = {"seq": len(facts), "concept": own.get("name", ""), "context": own.get("contextref", ""), "unit": own.get("unitref"), "text": None, "nil": own.get("xsi:nil", "").strip() in ("true", "1")}
                fact |= {n: own.get(n) for n in ("scale", "decimals", "sign", "format")}
                facts.append(fact)
                if written.endswith("/"):
                    fact["text"] = ""
                else:
                    open_facts.append((what, fact, len(texts)))
            elif local == CONTEXT and own.get("id"):
                context = {"start": None, "end": None, "instant": None, "dims": {}}
                contexts.setdefault(own["id"], context)
            elif local == UNIT and own.get("id"):
                unit = []
                if own["id"] in units:
                    unit = None
                else:
                    unit_id = own["id"]
            elif context is not None and local in DATES:
                holds = (DATES[local], "")
            elif context is not None and local in MEMBERS:
                holds = ("dims", own.get("dimension", ""))
            elif unit is not None and local == "measure":
                holds = ("measure", "")
        elif what in (NUMBER, TEXT):
            if open_facts and open_facts[-1][0] == what:
                _, fact, first = open_facts.pop()
                fact["text"] = "".join(texts[first:]).strip() if sizes[-1] - sizes[first] <= MOST_DIGITS else ""
                if not open_facts:
                    texts, sizes = [], [0]
        elif local == CONTEXT:
            context = None
        elif local == UNIT and unit is not None:
            units[unit_id] = "/".join(x for x in unit if x)
            unit = None
        elif local in DATES or local in MEMBERS or local == "measure":
            holds = None
    return facts, contexts, units


def fact_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, html) to (doc_id, facts, contexts, units), a page at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            facts, contexts, units = tagged(batch.column(1)[i].as_py() or "")
            held = {k: c | {"dims": list(c["dims"].items())} for k, c in contexts.items()}
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([facts], _FACTS), pa.array([list(held.items())], _CONTEXTS), pa.array([list(units.items())], _UNITS)], names=["doc_id", "facts", "contexts", "units"])


def fact_number(text: Column, format: Column, sign: Column) -> Column:
    """The number as written, with its sign; dashes and the formats for zero are 0."""
    form = F.lower(F.coalesce(F.substring_index(format, ":", -1), F.lit("")))
    plain = F.regexp_replace(text, r"(?U)[\s']", "")
    comma = form.rlike("^(num-?comma-?decimal|numcommadot)$")
    digits = F.when(comma, F.replace(F.replace(plain, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(plain, F.lit(","), F.lit("")))
    value = F.when(form.rlike("zero|nodash|numdash") | plain.rlike("^[-–—]+$"), F.lit(0.0)).when(digits.rlike(r"^(\d+\.?\d*|\.\d+)$"), digits.try_cast("double"))
    return F.when(F.coalesce(sign, F.lit("")) == "-", -value).otherwise(value)


def fact_unit(measure: Column) -> Column:
    """The unit of a measure as quantities have it: money, a ratio of two measures, or a count; pure numbers are ratios."""
    name = F.lower(F.coalesce(measure, F.lit("")))
    return F.when(name.contains("/"), "ratio").when(name.rlike(r"(^|:)usd$"), "USD").when(name.rlike(r"(^|:)percent$"), "percent").when(name.rlike(r"(^|:)pure$"), "ratio").otherwise("count")


def context_period(start: Column, end: Column) -> Column:
    """A context's dates as a period: some 12 months as a fiscal year, 3 months as a quarter of it, others as months ended; an instant has no start.

    The year is the one in which the period ends, and one that ends in the first week of a year belongs to the year before.
    """
    settled = F.date_sub(end, 7)
    months = F.round(F.datediff(end, start) / 30.44).cast("int")
    none = F.lit(None).cast("int")
    year, quarter = F.year(settled), F.quarter(settled)
    made = lambda kind, q, m, label: F.struct(F.lit(kind).alias("kind"), year.alias("year"), q.alias("quarter"), m.alias("months"), (end if kind == "months_ended" else F.lit(None).cast("date")).alias("end_date"), label.alias("label")).cast(PERIOD)
    whole = made("FY", none, none, F.concat(F.lit("FY"), year.cast("string")))
    part = made("Q", quarter, none, F.concat(F.lit("Q"), quarter.cast("string"), F.lit(" FY"), year.cast("string")))
    other = made("months_ended", none, months, F.concat(months.cast("string"), F.lit(" months ended "), end.cast("string")))
    return F.when(end.isNull(), F.lit(None).cast(PERIOD)).when(start.isNull(), whole).when(months.between(11, 13), whole).when(months == 3, part).otherwise(other)


def facts(pages: DataFrame) -> DataFrame:
    """doc_id, seq, concept, start, end, dims, decimals and quantity of every numeric fact of (doc_id, html).

    Facts without a number, a known context or a unit are left out: they say nothing that can be compared.
    ``decimals`` is null where the fact is exact.
    """
    found = pages.select(F.col("doc_id").cast("string").alias("doc_id"), "html").mapInArrow(fact_rows, f"doc_id string, facts array<{FACT_TYPE}>, contexts map<string,{CONTEXT_TYPE}>, units map<string,string>")
    each = found.select("doc_id", "contexts", "units", F.explode("facts").alias("f")).filter("f.unit is not null and not f.nil")
    context = F.try_element_at("contexts", F.col("f.context"))
    staged = each.select(
        "doc_id", "f.seq", "f.concept", "f.decimals", F.col("f.text").alias("raw"), "f.scale",
        context["start"].try_cast("date").alias("start"), F.coalesce(context["end"], context["instant"]).try_cast("date").alias("end"), context["dims"].alias("dims"),
        F.try_element_at("units", F.col("f.unit")).alias("measure"), fact_number(F.col("f.text"), F.col("f.format"), F.col("f.sign")).alias("value"),
    )
    vocabulary = F.lower(F.substring_index("concept", ":", 1))
    scale = F.pow(F.lit(10.0), F.coalesce(F.col("scale").try_cast("int"), F.lit(0)).cast("double"))
    quantity = F.struct(F.col("value"), fact_unit(F.col("measure")).alias("unit"), scale.alias("scale"), context_period(F.col("start"), F.col("end")).alias("period"), F.when(vocabulary.isin(*GAAP_VOCABULARIES), "GAAP").otherwise("unknown").alias("basis"), F.col("raw")).cast(QUANTITY)
    known = staged.filter("value is not null and `end` is not null and measure is not null")
    return known.select("doc_id", "seq", "concept", "start", "end", F.coalesce("dims", F.create_map().cast("map<string,string>")).alias("dims"), F.col("decimals").try_cast("int").alias("decimals"), "measure", quantity.alias("quantity"))


def _key(f: DataFrame) -> DataFrame:
    dims = F.to_json(F.array_sort(F.map_entries("dims")))
    return f.withColumn("_key", F.sha2(F.to_json(F.struct("concept", "start", "end", "measure", dims.alias("dims")), {"ignoreNullFields": "false"}), 256))


def resolved(found: DataFrame) -> DataFrame:
    """One row for each fact of a document, the most precise telling, with ``told``, the tellings, and ``conflict``: whether some telling is off by more than half a unit of its last digit."""
    keyed = _key(found).withColumn("_value", F.col("quantity.value") * F.col("quantity.scale"))
    rank = F.struct(F.coalesce("decimals", F.lit(1 << 20)).alias("decimals"), (-F.col("seq")).alias("first"))
    best = keyed.groupBy("doc_id", "_key").agg(F.max_by(F.struct(*(c for c in found.columns if c != "doc_id"), "_value"), rank).alias("b"), F.count("*").alias("told"))
    off = F.abs(F.col("_value") - F.col("b._value")) > F.when(F.col("decimals").isNull(), F.lit(0.0)).otherwise(0.5 * F.pow(F.lit(10.0), -F.col("decimals").cast("double")))
    torn = keyed.join(best.filter("told > 1"), ["doc_id", "_key"]).filter(off).select("doc_id", "_key").distinct().withColumn("_torn", F.lit(True))
    return best.join(torn, ["doc_id", "_key"], "left").select("doc_id", *(F.col("b")[c].alias(c) for c in found.columns if c != "doc_id"), "told", F.coalesce("_torn", F.lit(False)).alias("conflict"))


#: Days by which a context's ends may differ from a claim's period: fiscal years of whole weeks.
SLACK_DAYS = 10


def claim_interval(period: Column, year_end_month: Column | int = 12) -> tuple[Column, Column]:
    """(first, last day) of a claim's period in fiscal years that end with a month."""
    month = year_end_month if isinstance(year_end_month, Column) else F.lit(year_end_month)
    year_end = F.last_day(F.make_date(period["year"], month, F.lit(1)))
    back = F.when(period["kind"] == "Q", (period["quarter"] - 4) * 3).otherwise(0)
    last = F.when(period["kind"] == "months_ended", period["end_date"]).otherwise(F.last_day(F.add_months(year_end, back)))
    length = F.when(period["kind"] == "Q", 3).when(period["kind"] == "months_ended", period["months"]).otherwise(12)
    return F.date_add(F.last_day(F.add_months(last, -length)), 1), last


def fact_evidence(claims: DataFrame, asked: DataFrame, found: DataFrame, year_end_month: int = 12, slack_days: int = SLACK_DAYS) -> DataFrame:
    """Evidence from facts for claims (claim_id, period, operation), by what is asked for each (claim_id, doc_id, concepts).

    A fact without dimensions answers a concept where its context's days are those
    of the claim's period, give or take ``slack_days``; growth also asks for the
    period a year before.  Facts and claims meet on document, concept and the month
    around the last day, and the interval decides.  Quantities come in the order of
    concepts, the claim's own period first; periods of the asked concepts that a
    document has at all are its covered periods.  A claim that finds nothing has an empty row.
    """
    first, last = claim_interval(F.col("period"), year_end_month)
    want = claims.select("claim_id", "period", "operation").join(asked, "claim_id").select("claim_id", "doc_id", "operation", first.alias("first"), last.alias("last"), F.posexplode("concepts").alias("i", "concept"))
    steps = F.when(F.col("operation") == "growth", F.array(F.lit(0), F.lit(12))).otherwise(F.array(F.lit(0)))
    each = want.select("claim_id", "doc_id", "concept", "i", "first", "last", F.posexplode(steps).alias("step", "back"))
    each = each.select("claim_id", "doc_id", "concept", "i", "step", F.add_months("first", -F.col("back")).alias("first"), F.last_day(F.add_months("last", -F.col("back"))).alias("last"))
    month = lambda day: F.year(day) * 12 + F.month(day)
    probes = each.withColumn("month", F.explode(F.sequence(month(F.date_sub("last", slack_days)), month(F.date_add("last", slack_days)))))
    whole = found.filter(F.size("dims") == 0)
    held = whole.select("doc_id", "concept", month(F.col("end")).alias("month"), "start", "end", "seq", "quantity")
    a, b = probes.alias("a"), held.alias("b")
    near = (F.abs(F.datediff("b.end", "a.last")) <= slack_days) & (F.col("b.start").isNull() | (F.abs(F.datediff("b.start", "a.first")) <= slack_days))
    met = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.concept") == F.col("b.concept")) & (F.col("a.month") == F.col("b.month")) & near)
    rows = met.select("a.claim_id", "b.doc_id", F.struct("a.i", "a.step", "b.seq", F.concat(F.lit("fact:"), F.col("b.concept"), F.lit(":"), F.col("b.seq").cast("string")).alias("node"), F.col("b.quantity").alias("q")).alias("e"))
    mine = rows.groupBy("claim_id").agg(F.array_sort(F.collect_list("e"), lambda x, y: _earlier(x, y)).alias("e"), F.min("doc_id").alias("doc_id"))
    periods = whole.groupBy("doc_id", "concept").agg(F.collect_set("quantity.period").alias("periods"))
    covered = asked.select("claim_id", "doc_id", F.explode("concepts").alias("concept")).join(periods, ["doc_id", "concept"]).groupBy("claim_id").agg(F.array_distinct(F.flatten(F.collect_list("periods"))).alias("periods"))
    none = F.array().cast("array<string>")
    return claims.select("claim_id").join(mine, "claim_id", "left").join(covered, "claim_id", "left").select(
        "claim_id",
        F.coalesce(F.transform("e", lambda x: x["q"]), F.array().cast(f"array<{QUANTITY}>")).alias("quantities"),
        F.coalesce("periods", F.array().cast(f"array<{PERIOD}>")).alias("covered_periods"),
        F.coalesce("doc_id", F.lit("")).alias("doc_id"),
        F.coalesce(F.transform("e", lambda x: x["node"]), none).alias("node_ids"),
        F.lit("").alias("citation_url"),
        F.lit("").alias("quote"),
    )


def _earlier(x: Column, y: Column) -> Column:
    a, b = (F.struct(e["step"], e["i"], e["seq"]) for e in (x, y))
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)
