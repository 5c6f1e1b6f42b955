"""Filters, tallies and run reports over verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..types import RUN_FAILED

#: Fixed: how a status is shown.
LABELS = {"SUPPORTED": ("Supported", "good"), "CONTRADICTED": ("Contradicted", "bad"), "BASIS_MISMATCH": ("Basis mismatch", "warn"), "NO_EVIDENCE": ("No evidence", "mute"), "NO_SOURCE": ("No source", "mute"), "RUN_FAILED": ("Run failed", "bad")}


def bucket(status: Column) -> Column:
    """The four buckets of a tally; failed runs count with the contradicted."""
    return F.when(status == "SUPPORTED", "supported").when(status.isin("CONTRADICTED", RUN_FAILED), "contradicted").when(status == "BASIS_MISMATCH", "basis").otherwise("none")


def tally(verdicts: DataFrame, *by: str) -> DataFrame:
    """Verdicts per bucket."""
    own = bucket(F.col("status"))
    return verdicts.groupBy(*by).agg(*(F.count_if(own == b).alias(b) for b in ("supported", "contradicted", "basis", "none")), F.count("*").alias("total"))


def label(status: Column, part: int = 0) -> Column:
    shown = F.create_map(*(F.lit(x) for k, v in LABELS.items() for x in (k, v[part])))
    return F.coalesce(F.try_element_at(shown, status), status)


def by_status(verdicts: DataFrame, status: str) -> DataFrame:
    wanted = ("CONTRADICTED", RUN_FAILED) if status == "CONTRADICTED" else (status,)
    return verdicts.filter(F.col("status").isin(*wanted))


def matching(claims: DataFrame, operation: str | None = None, text: str | None = None) -> DataFrame:
    """Claims of an operation whose text, in either case, or figure, as written, holds a string."""
    out = claims if operation is None else claims.filter(F.col("operation") == operation)
    return out if not text else out.filter(F.lower("text").contains(text.lower()) | F.col("figure").contains(text))


def operations_seen(claims: DataFrame, pos: str, *by: str) -> DataFrame:
    """operation, first position and count, in the order they are first seen; with the number carried where claims say so."""
    more = [F.count_if("carried").alias("carried")] if "carried" in claims.columns else []
    return claims.groupBy(*by, "operation").agg(F.min(pos).alias("first_pos"), F.count("*").alias("n"), *more).orderBy("first_pos")


def carried(claims: DataFrame, later: DataFrame, *keys: str) -> DataFrame:
    """``claims`` with whether a later extraction has them too."""
    seen = later.select(*keys).distinct().withColumn("carried", F.lit(True))
    return claims.join(seen, list(keys), "left").withColumn("carried", F.coalesce("carried", F.lit(False)))


def missing(expected: DataFrame, seen: DataFrame, *keys: str) -> DataFrame:
    """Expected rows of which none was seen."""
    return expected.join(seen.select(*keys), list(keys), "left_anti")


def hit(status: Column, expected: Column) -> Column:
    """Whether a status is one of the expected, which are joined by |."""
    return F.array_contains(F.split(expected, r"\|"), status)


def leaderboard(runs: DataFrame) -> DataFrame:
    """Runs (model, case, status, expected, seconds, rejected) by model: most hits first, then the quickest."""
    ok = F.coalesce(hit(F.col("status"), F.col("expected")), F.lit(False))
    per = runs.groupBy("model").agg(
        F.count_if(ok).alias("hits"), F.count("*").alias("total"), F.sum("seconds").alias("seconds"), F.max("seconds").alias("slowest"),
        F.count_if(F.coalesce("rejected", F.lit("")) != "").alias("rejected_evidence"), F.count_if(F.col("status") == RUN_FAILED).alias("run_failed"),
    )
    return per.orderBy(F.desc("hits"), "seconds", "model")


def missed_by_all(runs: DataFrame) -> DataFrame:
    """Cases that no model got right."""
    ok = F.coalesce(hit(F.col("status"), F.col("expected")), F.lit(False))
    return runs.groupBy("case").agg(F.bool_or(ok).alias("any_hit")).filter("not any_hit").select("case")


def misses(runs: DataFrame) -> DataFrame:
    return runs.filter(~F.coalesce(hit(F.col("status"), F.col("expected")), F.lit(False)))


def wall_clock(runs: DataFrame) -> DataFrame:
    """Seconds in sequence and side by side."""
    per = runs.groupBy("model").agg(F.sum("seconds").alias("s"))
    return per.agg(F.sum("s").alias("sequential"), F.max("s").alias("parallel"))


def seeded(note: Column) -> Column:
    return F.coalesce(note.contains("seeded"), F.lit(False))


def caught(runs: DataFrame) -> DataFrame:
    """Seeded defects caught and missed, and clean claims falsely flagged."""
    bad, ok = seeded(F.col("why")), F.coalesce(hit(F.col("status"), F.col("expected")), F.lit(False))
    return runs.agg(F.count_if(bad & ok).alias("caught"), F.count_if(bad & ~ok).alias("missed"), F.count_if(~bad & ~ok).alias("falsely_flagged"))


def event_tape(events: DataFrame, stream: str, *order: str) -> DataFrame:
    """Events with a running number and whether each is the newest of its stream."""
    w = Window.partitionBy(stream).orderBy(*order)
    return events.withColumns({"seq": F.row_number().over(w), "is_last": F.lead(F.lit(1)).over(w).isNull()})


def progress(events: DataFrame, stream: str, *order: str) -> DataFrame:
    """Events with the number of verdicts so far and still to come."""
    w = Window.partitionBy(stream)
    is_verdict = (F.col("kind") == "verdict").cast("long")
    done = F.sum(is_verdict).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("completed", done).withColumn("remaining", F.sum(is_verdict).over(w) - F.col("completed"))


def seed_defects(claims: DataFrame, seed: Column) -> DataFrame:
    """Clean claims with one of six defects by ``seed``: none, scale, digits, period, sign, unit or basis, named in why."""
    kind = F.element_at(F.array(*(F.lit(x) for x in ("", "scale", "digits", "period", "sign", "unit", "basis"))), (F.pmod(seed, F.lit(7)) + 1).cast("int"))
    v = F.col("value")
    changed = (
        F.when(kind == "scale", v.withField("scale", v["scale"] * 1000.0))
        .when(kind == "digits", v.withField("value", v["value"] * 3.0))
        .when(kind == "period", v.withField("period", v["period"].withField("year", v["period"]["year"] - 1)))
        .when(kind == "sign", v.withField("value", -v["value"]))
        .when(kind == "unit", v.withField("unit", F.lit("percent")))
        .when(kind == "basis", v.withField("basis", F.lit("adjusted")))
        .otherwise(v)
    )
    return claims.withColumn("value", changed).withColumn("why", F.when(kind == "", "clean").otherwise(F.concat(F.lit("seeded: "), kind)))
