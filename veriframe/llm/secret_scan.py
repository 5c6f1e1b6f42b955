"""Operator 5 [native]: secret scan over a trigram inverted index.

From each rule's regex a Boolean trigram query is derived: an OR of ANDs of
trigrams that any match must contain, lower-cased.  The inverted index holds,
for every trigram that some query asks for, the documents that contain it; the
queries are answered by intersecting postings, and only the candidates are
matched against the rule.  A rule without mandatory trigrams scans all texts.
Everything runs as DataFrame expressions.

A match's place follows from the texts between matches: splitting by the rule
gives the pieces around what extraction gives.

Defined results: a null or empty text has no spans; very long texts are scanned
whole; rows are given back as often as they come; other columns, whatever their
names, are ignored; an empty table gives no rows; offsets are code points, ends
exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as c
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` count when their ``group`` has ``least`` characters or more.

    ``scan`` is a pattern that gives just the matches that count, where there is one.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    scan: str | None = None


#: Fixed patterns of the base kinds, and further kinds after them.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    # greedy runs: a run that counts is matched whole from the same place, a shorter one not at all
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]+", 0, 32, r"[0-9a-f]{32,}+"),
)
FURTHER = (
    Rule("github", r"gh[opsu]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abp]-[A-Za-z0-9-]+", 0, 20),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + FURTHER
_MOST_WAYS = 64


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of mandatory trigrams of any match, or None if some match has none."""
    ways = _walk(_parser.parse(pattern), {(frozenset(), "")})
    found = {grams for grams, _ in ways}
    if frozenset() in found:
        return None
    return sorted((g for g in found if not any(h < g for h in found)), key=sorted)


def _walk(parsed, ways: set[tuple[frozenset, str]]) -> set[tuple[frozenset, str]]:
    """Each way is the trigrams so far and the literal text that ends here."""
    for op, arg in parsed:
        if op is c.LITERAL:
            ways = _literal(ways, chr(arg))
        elif op is c.IN and all(x[0] is c.LITERAL for x in arg) and len(arg) <= 4:
            ways = set().union(*(_literal(ways, chr(x[1])) for x in arg))
        elif op is c.BRANCH:
            ways = set().union(*(_walk(branch, ways) for branch in arg[1]))
        elif op is c.SUBPATTERN:
            ways = _walk(arg[3], ways)
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
            low, high, item = arg
            once = _walk(item, ways) if low or high == 1 else ways
            ways = once if (low, high) == (1, 1) else once | ways if (low, high) == (0, 1) else {(g, "") for g, _ in once}
        elif op is not c.AT:
            ways = {(g, "") for g, _ in ways}
        if len(ways) > _MOST_WAYS:
            ways = {(frozenset.intersection(*(g for g, _ in ways)), "")}
    return ways


def _literal(ways: set[tuple[frozenset, str]], char: str) -> set[tuple[frozenset, str]]:
    out = set()
    for grams, end in ways:
        end = (end + char.lower())[-3:]
        out.add((grams | {end} if len(end) == 3 else grams, end))
    return out


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, doc_id, tid): the inverted index of ``trigrams`` over the lower-cased texts."""
    low = F.lower("text")
    held = F.array_compact(F.array(*(F.when(low.contains(t), F.lit(t)) for t in trigrams)))
    return docs.select("doc_id", "tid", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, tid, kinds): the rules with mandatory trigrams that a document can match."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    wanted = [(kind, i, len(ways), t) for kind, q in queries.items() for i, ways in enumerate(q) for t in sorted(ways)]
    # as many rows as the rules' queries have trigrams
    query = F.broadcast(docs.sparkSession.createDataFrame(wanted, "kind string, way int, size int, trigram string"))
    index = table(postings(docs, sorted({x[3] for x in wanted})).distinct())
    met = index.join(query, "trigram").groupBy("doc_id", "tid", "kind", "way").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    return met.filter("n = size").groupBy("doc_id", "tid").agg(F.collect_set("kind").alias("kinds"))


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """Array of (start, number, end) of the rule's matches."""
    scan = rule.scan or rule.pattern
    pattern = F.lit(scan)
    match, group = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(rule.group))
    parts = F.transform(F.arrays_zip(F.split(text, scan, -1).alias("gap"), match.alias("match"), group.alias("group")), lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["match"]).alias("match"), F.length(x["group"]).alias("group")))
    kind = "array<struct<start:int,number:int,end:int>>"
    first = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(x["match"], F.lit(0))
        span = F.array(F.struct(start.alias("start"), F.lit(number).alias("number"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["group"] >= rule.least, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(scan), F.aggregate(parts, first, step, lambda acc: acc["out"])).otherwise(F.array().cast(kind))


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans, an array of (start, number of the rule, end) by start and rule, of every document."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tid"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d, k = keyed.alias("d"), candidates(keyed, rules).alias("k")
    on = (F.col("d.tid") == F.col("k.tid")) & F.col("d.doc_id").eqNullSafe(F.col("k.doc_id"))
    joined = d.join(k, on, "left").select("d.doc_id", "d.text", "k.kinds")
    found = []
    for number, rule in enumerate(rules):
        spans = _spans(F.col("text"), rule, number)
        if trigram_query(rule.pattern) is not None:
            spans = F.when(F.array_contains("kinds", rule.kind), spans).otherwise(F.array().cast("array<struct<start:int,number:int,end:int>>"))
        found.append(spans)
    return joined.select("doc_id", F.array_sort(F.concat(*found)).alias("spans"))


def span_digests(scanned: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = len(BASE)) -> DataFrame:
    """doc_id, a count for each base kind, base_sha256 and spans as text."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["number"]), x["start"].cast("string"), x["end"].cast("string"))), ",")

    own = F.filter("spans", lambda x: x["number"] < base)

    def of(number: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["number"] == number)).cast("long")

    counts = [of(i).alias(f"n_{r.kind}") for i, r in enumerate(rules[:base])]
    return scanned.select("doc_id", *counts, F.sha2(joined(own), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
