"""Tagged facts, descents of section trees, and verdicts where both sides stream."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from veriframe.operators import compare, navigate, tree
from veriframe.plans import catalog
from veriframe.sources import xbrl
from veriframe.streaming import joined
from veriframe.types import CLAIMS, EVIDENCE

CONTEXTS = """<xbrli:context id="fy"><xbrli:entity/><xbrli:period><xbrli:startDate>2022-12-31</xbrli:startDate><xbrli:endDate>2023-12-30</xbrli:endDate></xbrli:period></xbrli:context>
<xbrli:context id="fy"><xbrli:period><xbrli:instant>1999-01-01</xbrli:instant></xbrli:period></xbrli:context>
<xbrli:context id="q3"><xbrli:period><xbrli:startDate>2023-07-01</xbrli:startDate><xbrli:endDate>2023-09-30</xbrli:endDate></xbrli:period></xbrli:context>
<xbrli:context id="nine"><xbrli:period><xbrli:startDate>2023-01-01</xbrli:startDate><xbrli:endDate>2023-09-30</xbrli:endDate></xbrli:period></xbrli:context>
<xbrli:context id="now"><xbrli:period><xbrli:instant>2024-01-01</xbrli:instant></xbrli:period></xbrli:context>
<xbrli:context id="seg"><xbrli:segment><xbrldi:explicitMember dimension="a:Axis">b:One</xbrldi:explicitMember></xbrli:segment><xbrli:period><xbrli:instant>2023-12-31</xbrli:instant></xbrli:period></xbrli:context>
<xbrli:unit id="usd"><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unit><xbrli:unit id="n"><xbrli:measure>xbrli:shares</xbrli:measure></xbrli:unit>
<xbrli:unit id="per"><xbrli:divide><xbrli:unitNumerator><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unitNumerator><xbrli:unitDenominator><xbrli:measure>xbrli:shares</xbrli:measure></xbrli:unitDenominator></xbrli:divide></xbrli:unit>"""


def number(name, context, text, unit="usd", **more):
    return f'<ix:nonFraction name="{name}" contextRef="{context}" unitRef="{unit}" {" ".join(f"{k}={v!r}" for k, v in more.items())}>{text}</ix:nonFraction>'


FACTS = [
    # page text, then what it says: concept, value, unit, scale, kind of period, year, decimals
    (number("us-gaap:Sales", "fy", "7,&#49;50", scale="3", decimals="-3"), ("us-gaap:Sales", 7150.0, "USD", 1e3, "FY", 2023, -3)),
    (number("us-gaap:Sales", "q3", "1.907,5", scale="3", decimals="2", format="ixt:num-comma-decimal"), ("us-gaap:Sales", 1907.5, "USD", 1e3, "Q", 2023, 2)),
    (number("us-gaap:Loss", "nine", "<span>3</span>1", sign="-", decimals="INF"), ("us-gaap:Loss", -31.0, "USD", 1.0, "months_ended", 2023, None)),
    (number("x:Debt", "now", "—", decimals="0"), ("x:Debt", 0.0, "USD", 1.0, "FY", 2023, 0)),
    (number("x:Debt", "seg", "none", format="ixt:fixed-zero", decimals="0"), ("x:Debt", 0.0, "USD", 1.0, "FY", 2023, 0)),
    (number("x:Staff", "now", "12 345", unit="n", decimals="0"), ("x:Staff", 12345.0, "count", 1.0, "FY", 2023, 0)),
    (number("x:Gain", "fy", "0.42", unit="per", decimals="2"), ("x:Gain", 0.42, "ratio", 1.0, "FY", 2023, 2)),
    # a fact within a text within a fact
    (number("x:Outer", "fy", '<ix:nonNumeric name="x:T" contextRef="fy">' + number("x:Inner", "fy", "55") + "</ix:nonNumeric>"), ("x:Outer", 55.0, "USD", 1.0, "FY", 2023, None)),
    ("", ("x:Inner", 55.0, "USD", 1.0, "FY", 2023, None)),
    (number("x:NoContext", "gone", "5"), None),
    (number("x:NoUnit", "fy", "5", unit="gone"), None),
    (number("x:NoNumber", "fy", "five"), None),
    (number("x:Long", "fy", "9" * 300), None),
    ('<ix:nonFraction name="x:Nil" contextRef="fy" unitRef="usd" xsi:nil="true"/>', None),
    ('<ix:nonFraction name="x:Open" contextRef="fy" unitRef="usd">8', None),
]


def pages(spark, *html):
    return spark.createDataFrame([(f"d{i}", h, "x", 1) for i, h in enumerate(html)], "doc_id string, html string, concept string, seq int")


def test_facts(spark):
    got = xbrl.facts(pages(spark, f"<html><ix:header>{CONTEXTS}</ix:header>" + "".join(t for t, _ in FACTS), None, "", "<p>no facts</p>")).orderBy("seq").collect()
    shown = [(r.concept, r.quantity.value, r.quantity.unit, r.quantity.scale, r.quantity.period.kind, r.quantity.period.year, r.decimals) for r in got]
    assert shown == [f for _, f in FACTS if f]
    assert {r.concept: r.quantity.basis for r in got}["us-gaap:Loss"] == "GAAP" and got[3].quantity.basis == "unknown"
    assert [r.dims for r in got if r.dims] == [{"a:Axis": "b:One"}]
    assert got[2].quantity.period.months == 9 and got[1].quantity.period.quarter == 3


def test_precise_tellings_win(spark):
    html = CONTEXTS + number("a:X", "fy", "1,234", scale="3", decimals="-3") + number("a:X", "fy", "1", scale="6", decimals="-6") + number("a:X", "fy", "1234499", decimals="INF")
    html += number("a:Y", "fy", "70", decimals="0") + number("a:Y", "fy", "71", decimals="0") + number("a:Y", "q3", "9") + number("a:Y", "fy", "70", decimals="0", unit="n")
    got = {(r.concept, r.start.month, r.measure): (r.quantity.value, r.told, r.conflict) for r in xbrl.resolved(xbrl.facts(pages(spark, html))).collect()}
    assert got == {("a:X", 12, "iso4217:USD"): (1234499.0, 3, False), ("a:Y", 12, "iso4217:USD"): (70.0, 2, True), ("a:Y", 7, "iso4217:USD"): (9.0, 1, False), ("a:Y", 12, "xbrli:shares"): (70.0, 1, False)}


def test_parsing_time_follows_length():
    import time

    def took(n):
        html = CONTEXTS + "".join(f'<ix:nonFraction name="a:{i}" contextRef="fy" unitRef="usd">' for i in range(n)) + "1 " * n + "</ix:nonFraction>" * n
        began = time.perf_counter()
        facts, _, _ = xbrl.tagged(html)
        assert len(facts) == n
        return time.perf_counter() - began

    took(1000)
    assert took(16_000) < 10 * max(took(4000), 0.01)


def fy(year):
    return ("FY", year, None, None, None, f"FY{year}")


def test_facts_decide_claims(spark):
    html = CONTEXTS + number("a:Sales", "fy", "7,150", scale="3", decimals="-3") + number("a:Sales", "q3", "1,900", scale="3", decimals="-3") + number("a:Sales", "seg", "999")
    html += number("a:Cost", "fy", "3,575", scale="3", decimals="-3")
    html += '<xbrli:context id="old"><xbrli:period><xbrli:startDate>2022-01-01</xbrli:startDate><xbrli:endDate>2022-12-30</xbrli:endDate></xbrli:period></xbrli:context>' + number("a:Sales", "old", "5,500", scale="3", decimals="-3")
    found = xbrl.resolved(xbrl.facts(pages(spark, html)))
    usd = lambda v, raw, p: (v, "USD", 1e6, p, "unknown", raw)
    q3 = ("Q", 2023, 3, None, None, "Q3 FY2023")
    rows = [
        (1, "", usd(7.15, "7.15", fy(2023)), "absolute", fy(2023), "unknown"),
        (2, "", usd(1.9, "1.9", q3), "absolute", q3, "unknown"),
        (3, "", (30.0, "percent", 1.0, fy(2023), "unknown", "30"), "growth", fy(2023), "unknown"),
        (4, "", (50.0, "percent", 1.0, fy(2023), "unknown", "50"), "margin", fy(2023), "unknown"),
        (5, "", usd(7.15, "7.15", fy(2021)), "absolute", fy(2021), "unknown"),
        (6, "", usd(7.15, "7.15", fy(2023)), "absolute", fy(2023), "unknown"),
    ]
    claims = spark.createDataFrame(rows, CLAIMS)
    asked = spark.createDataFrame([(1, "d0", ["a:Sales"]), (2, "d0", ["a:Sales"]), (3, "d0", ["a:Sales"]), (4, "d0", ["a:Cost", "a:Sales"]), (5, "d0", ["a:Sales"]), (6, "d9", ["a:Sales"])], "claim_id bigint, doc_id string, concepts array<string>")
    got = compare.verdicts(claims, xbrl.fact_evidence(claims, asked, found)).orderBy("claim_id").collect()
    assert [(r.status, r.actual) for r in got] == [("SUPPORTED", 7.15e6), ("SUPPORTED", 1.9e6), ("SUPPORTED", 30.0), ("SUPPORTED", 50.0), ("NO_SOURCE", None), ("NO_SOURCE", None)]


# --- navigation -------------------------------------------------------------------


def brute(requests, nodes, lines, k, budget):
    out = []
    for request, doc, text in requests:
        terms = set(w for w in re.findall("[a-z0-9]+", text.lower()) if len(w) > 3 and w not in catalog.g.STOP_WORDS)
        mine = [n for n in nodes if n.doc_id == doc]

        def score(n, doc=doc, terms=terms):
            found = [w for ln in lines if ln.doc_id == doc and n.line_start <= ln.line_no <= n.line_end for w in re.findall("[a-z0-9]+", ln.text.lower()) if w in terms]
            return len(set(found)), len(found)

        frontier, step = [n for n in mine if n.parent_id == "root"], 0
        while frontier and step < budget:
            frontier.sort(key=lambda n: (*(-x for x in score(n)), n.line_start, n.node_id))
            taken, frontier = frontier[: min(k, budget - step)], frontier[min(k, budget - step) :]
            for n in taken:
                step += 1
                out.append((request, doc, step, n.node_id, *score(n)))
                if score(n)[1]:
                    frontier += [c for c in mine if c.parent_id == n.node_id]
    return sorted(out)


@pytest.mark.parametrize("k,budget", [(1, 4), (2, 7), (5, 3)])
def test_descent(spark, k, budget):
    docs = catalog.outlines(spark, "/root/testdata/sf0.001").filter("try_cast(doc_id as int) < 40")
    lines = tree.lines_of(docs)
    nodes = tree.build_tree(lines, min_lines=1)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").orderBy("item_id").collect()]
    requests = [(i % 3, str(i), texts[i % len(texts)]) for i in range(40)] + [(7, "3", texts[0]), (8, "gone", texts[0]), (9, "5", "")]
    asked = spark.createDataFrame(requests, "request int, doc_id string, text string")
    got = navigate.descend(asked, nodes, navigate.section_scores(asked, nodes, lines), k, budget)
    assert sorted(tuple(r) for r in got.select("request", "doc_id", "step", "node_id", "n_terms", "n_hits").collect()) == brute(requests, nodes.collect(), lines.select("doc_id", "line_no", "text").collect(), k, budget)


def test_lines_know_their_sections(spark):
    docs = catalog.outlines(spark, "/root/testdata/sf0.001").filter("try_cast(doc_id as int) < 30")
    lines = tree.lines_of(docs)
    for least in (1, 6):
        nodes = tree.build_tree(lines, min_lines=least)
        held = nodes.collect()
        for r in tree.line_sections(lines, nodes).collect():
            inside = [n for n in held if n.doc_id == r.doc_id and n.line_start <= r.line_no <= n.line_end]
            assert r.sections == [n.node_id for n in sorted(inside, key=lambda n: (n.line_start, n.level))]


def test_no_requests_and_no_documents(spark):
    docs = catalog.outlines(spark, "/root/testdata/sf0.001").limit(3)
    none = spark.createDataFrame([], "request int, doc_id string, text string")
    assert navigate.navigate(none, docs).count() == 0
    assert navigate.navigate(spark.createDataFrame([(1, "0", "some text")], none.schema), docs.limit(0)).count() == 0


# --- streams ----------------------------------------------------------------------

VALUE = (8.1, "USD", 1e6, fy(2023), "GAAP", "8.1")
AT = dt.datetime(2024, 5, 1, 12, 0)


def minutes(n):
    return AT + dt.timedelta(minutes=n)


class Feed:
    def __init__(self, spark, path):
        self.spark, self.path, self.n = spark, path, 0
        self.claim = f"run_id string, asked_at timestamp, {CLAIMS}"
        self.found = f"run_id string, found_at timestamp, {EVIDENCE}"

    def add(self, claims=(), evidence=()):
        rows = [("r", minutes(m), i, "t", VALUE, "absolute", fy(2023), "GAAP") for i, m in claims]
        self.spark.createDataFrame(rows, self.claim).coalesce(1).write.mode("append").parquet(f"{self.path}/claims")
        rows = [("r", minutes(m), i, [(x, "USD", 1.0, fy(2023), "GAAP", str(x))], [fy(2023)], "d", ["n"], "", "") for i, m, x in evidence]
        self.spark.createDataFrame(rows, self.found).coalesce(1).write.mode("append").parquet(f"{self.path}/evidence")

    def run(self):
        read = self.spark.readStream
        query = joined.start(read.schema(self.claim).parquet(f"{self.path}/claims"), read.schema(self.found).parquet(f"{self.path}/evidence"), f"{self.path}/out", f"{self.path}/checkpoint")
        query.awaitTermination()
        state = [s for s in query.recentProgress if s["stateOperators"]]
        return sorted((r.claim_id, r.status) for r in self.spark.read.parquet(f"{self.path}/out").collect()), state[-1]["stateOperators"] if state else []


def test_claims_and_evidence_stream(spark, tmp_path):
    feed = Feed(spark, f"file://{tmp_path}")
    feed.add([(1, 0), (2, 1), (3, 2), (3, 2)], [(1, 5, 8_100_000.0)])
    assert feed.run()[0] == [(1, "SUPPORTED")]
    # evidence that comes late, but in time, after a restart; a claim that is told again; evidence that is told again
    feed.add([(1, 3), (4, 40)], [(2, 50, 9_900_000.0), (1, 6, 1.0)])
    assert feed.run()[0] == [(1, "SUPPORTED"), (2, "CONTRADICTED")]
    # both streams move on: claims without evidence in time come out, their state goes, and evidence too late changes nothing
    feed.add([(90, 300)], [(90, 301, 8_100_000.0)])
    feed.run()
    feed.add([(91, 305)], [(3, 306, 8_100_000.0), (91, 306, 8_100_000.0)])
    got, state = feed.run()
    assert got == [(1, "SUPPORTED"), (2, "CONTRADICTED"), (3, "NO_SOURCE"), (4, "NO_SOURCE"), (90, "SUPPORTED"), (91, "SUPPORTED")]
    assert feed.run()[0] == got  # nothing new
    join = [s for s in state if "Join" in s["operatorName"] or "join" in s["operatorName"]]
    assert join and join[0]["numRowsTotal"] <= 5


def test_no_output_is_read(spark, tmp_path):
    feed = Feed(spark, f"file://{tmp_path}")
    feed.add([(1, 0)], [(1, 1, 8_100_000.0)])
    plan = joined.verdict_stream(spark.readStream.schema(feed.claim).parquet(f"{feed.path}/claims"), spark.readStream.schema(feed.found).parquet(f"{feed.path}/evidence"))
    assert plan.isStreaming and plan.columns == [*joined.SHOWN]
    assert spark.createDataFrame([(1,)], "x int").select(F.lit(1)).count() == 1
