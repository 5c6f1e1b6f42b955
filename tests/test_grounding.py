import json

from pyspark.sql import functions as F

from veriframe.functions import grounding as g
from veriframe.operators import containment, validate

CONTENT = "(in thousands)\n| Harbour dues (net) | 31,906 | (7,250) |\n| Pilotage | 1,480,063 | 990,417 |\n| Berths in use | 88 | 86 |"
TITLE, CITE = "Income from the port", "https://port.example/annual#dues"
CLAIM = "Net harbour dues came to $32 million last year"
GOOD = {"claim_index": 0, "verdict": "SUPPORTED", "found": "31,906", "quote": "harbour dues net 31,906", "doc_id": "d", "node_ids": ["n5"]}


def test_figures(spark):
    raws = {"31,906": True, "$31906": True, "31,906.00": True, "1,480,063": True, "88.5": True, "7250": True, "412,000": False, "$55.17": False, "": False, None: False}
    got = spark.createDataFrame([(r,) for r in raws], "r string").select("r", g.figure_retrievable(F.col("r"), g.digits(F.lit(CONTENT))).alias("ok")).collect()
    assert {r.r: r.ok for r in got} == raws


def test_quotes(spark):
    quotes = {"Harbour dues (net) 31,906": True, "berths   IN use, 88": True, "the ferry was late again": False, "Pilotage 1": False, "": False}
    got = spark.createDataFrame([(x,) for x in quotes], "q string").select("q", g.quote_retrievable(F.col("q"), g.squeezed(F.lit(CONTENT))).alias("ok")).collect()
    assert {r.q: r.ok for r in got} == quotes


def test_turns(spark):
    got = spark.range(0, 101, 10).select("id", g.turn_budget(F.col("id")).alias("n")).collect()
    assert [r.n for r in got] == [min(30, 6 + int(r.id * 0.5)) for r in got]


def results(spark, cases):
    """cases: (finding or None, claim text)"""
    claims = spark.createDataFrame([("r", i, c[1]) for i, c in enumerate(cases)], "run string, claim_index int, text string")
    answers = [("r", "<think>{x}</think> here " + json.dumps({"findings": [{**c[0], "claim_index": i} if "claim_index" in c[0] else c[0] for i, c in enumerate(cases) if c[0]]}) + " done")]
    findings = validate.parse_findings(validate.decode_findings(spark.createDataFrame(answers, "run string, content string")))
    rows = spark.createDataFrame([(i, 0, CONTENT, TITLE, CITE) for i, c in enumerate(cases) if c[0] and c[0].get("doc_id") == "d"], "request int, pos int, content string, title string, cite string")
    fetched = validate.gathered(rows).withColumns({"run": F.lit("r"), "claim_index": F.col("request")})
    return [r for r in validate.validate_all(claims, findings, fetched).orderBy("claim_index").collect()]


def test_contract(spark):
    """Fixed outcomes of a finding that holds and of what may be wrong with it."""
    cases = [
        (GOOD, CLAIM),
        ({k: v for k, v in GOOD.items() if k != "quote"}, CLAIM),
        ({**GOOD, "verdict": "MAYBE"}, CLAIM),
        ({**GOOD, "verdict": " no_source ", "doc_id": "", "node_ids": []}, CLAIM),
        ({**GOOD, "doc_id": "other"}, CLAIM),
        ({**GOOD, "found": "412,000"}, CLAIM),
        ({**GOOD, "found": "", "quote": "ferries that never sailed"}, CLAIM),
        ({**GOOD, "found": ""}, CLAIM),
        (GOOD, "Cranes were painted in spring"),
        (None, CLAIM),
    ]
    got = results(spark, cases)
    assert [r.status for r in got] == ["SUPPORTED", "NO_EVIDENCE", "NO_EVIDENCE", "NO_SOURCE", "NO_EVIDENCE", "NO_EVIDENCE", "NO_EVIDENCE", "SUPPORTED", "SUPPORTED", "NO_EVIDENCE"]
    starts = ["", "missing required fields: quote", "verdict is not", "", "cited node not", "figure is not", "quote is not", "", "", "agent returned no finding"]
    assert all(r.rejected.startswith(s) and bool(r.rejected) == bool(s) for r, s in zip(got, starts, strict=True))
    assert got[0].cite == CITE and got[3].cite == "" and got[1].cite == "" and got[0].warnings == [] and len(got[8].warnings) == 1


def test_answers_that_are_nearly_json(spark):
    answers = ['{"findings":[{"claim_index":1}]}', 'x {"findings":[{"claim_index":2},{"claim_index":3}]"}', "no json", None, '<think>{"findings":[]}</think>{"findings":[{"claim_index":4}]} tail }', '{"findings": 5}']
    got = validate.decode_findings(spark.createDataFrame([(str(i), a) for i, a in enumerate(answers)], "run string, content string")).collect()
    assert sorted((r.run, json.loads(r.finding)["claim_index"]) for r in got) == [("0", 1), ("1", 2), ("1", 3), ("4", 4)]


def test_evidence_of_figures(spark):
    finding = {"claim_index": 0, "doc_id": "d", "node_ids": ["n1"], "quote": "q", "figures": [{"raw": "31,906", "label": "Dues under GAAP", "unit": "", "period": "FY2022"}, {"raw": "412,000", "label": "", "unit": "", "period": ""}, {"raw": "1,480,063", "label": "Pilotage", "unit": "(in millions)", "period": ""}]}
    decoded = validate.decode_findings(spark.createDataFrame([("r", json.dumps({"findings": [finding]}))], "run string, content string"))
    rows = spark.createDataFrame([(0, 0, CONTENT, TITLE, CITE)], "request int, pos int, content string, title string, cite string")
    fetched = validate.gathered(rows).withColumns({"run": F.lit("r"), "claim_index": F.col("request")})
    claims = spark.createDataFrame([("r", 0), ("r", 1)], "run string, claim_index int")
    got = validate.to_evidence(claims, validate.parse_figure_findings(decoded), fetched).orderBy("claim_index").collect()
    assert [(q.value, q.scale, q.basis, q.period and q.period.year) for q in got[0].quantities] == [(31906.0, 1e3, "GAAP", 2022), (1480063.0, 1e6, "unknown", None)]
    assert got[0].quote == "[dropped, not present in the cited text: 412,000] q" and got[0].citation_url == CITE and len(got[0].covered_periods) == 1
    assert got[1].quantities == [] and got[1].citation_url == ""


def test_quotes_meet_texts(spark):
    quotes = spark.createDataFrame([(1, "Alpha beta gamma delta epsilon"), (2, "one two three"), (3, "not there at all anywhere"), (4, "too short")], "quote_id int, text string")
    texts = spark.createDataFrame([("a", "xalpha beta, gamma delta epsilonic"), ("b", "zone two threefold"), ("c", None)], "key string, text string")
    assert sorted(map(tuple, containment.quotes_in_texts(quotes, texts).collect())) == [(1, "a"), (2, "b")]
