"""The small operators around trees, retrieval, reports and files, against plain Python."""

import json
import random
import re

from pyspark.sql import functions as F

from veriframe.functions import grounding as g
from veriframe.operators import containment, extract, report, retrieve, tree, validate
from veriframe.sources import corpus, html_blocks, sinks
from veriframe.streaming import verify

NODES = [("a", "root", None, "A", 1, 20), ("a", "n1", "root", "Top", 1, 20), ("a", "n2", "n1", "Note 4 Leases", 5, 9), ("a", "n3", "n1", "Rest", 10, 20), ("b", "n1", "root", "Only", 1, 3)]
NODE = "doc_id string, node_id string, parent_id string, title string, line_start int, line_end int"


def test_nodes(spark):
    nodes = spark.createDataFrame(NODES, NODE)
    ids = lambda df: sorted((r.doc_id, r.node_id) for r in df.collect())
    assert ids(retrieve.structure(nodes, "b")) == [("b", "n1")] and ids(retrieve.find_node(nodes, "a", "n2")) == [("a", "n2")] and retrieve.find_node(nodes, "a", "n9").count() == 0
    assert {(r.doc_id, r.n_nodes) for r in tree.node_counts(nodes).collect()} == {("a", 3), ("b", 1)}
    with_text = tree.with_summaries(nodes, spark.createDataFrame([("a", "n2", "leases")], "doc_id string, node_id string, summary string"))
    assert {r.node_id: r.summary for r in with_text.filter("doc_id = 'a'").collect()} == {"root": None, "n1": None, "n2": "leases", "n3": None}
    content = spark.createDataFrame([("a", "n3", "See note 4, and see Note 4 and see note 7.")], "doc_id string, node_id string, content string")
    assert {(r.node_id, r.note, r.note_node) for r in tree.notes(content, nodes).collect()} == {("n3", "4", "n2"), ("n3", "7", None)}
    seen = spark.createDataFrame([("a", "n2"), ("b", "n9")], "doc_id string, node_id string")
    assert ids(tree.unread(nodes, seen)) == [("a", "n3"), ("b", "n1")]


def test_pages_are_sections(spark):
    pages = spark.createDataFrame([("p", 1, "a\nb"), ("p", 2, None), ("p", 3, "\n".join("x" * 60 for _ in range(9)))], "doc_id string, page int, text string")
    lines = tree.lines_of(corpus.paged_documents(pages))
    nodes = tree.with_addresses(tree.build_tree(lines, most_chars=100), lines)
    assert sorted((r.node_id, r.title, r.page_start, r.page_end) for r in nodes.collect()) == [("n1", "Page 1", 1, 1), ("n2", "Page 2", 2, 2), ("n3", "Page 3", 3, 3)]
    assert [r.doc_id for r in corpus.without_text(pages).collect()] == ["p"] and corpus.without_text(pages).first().page == 2


def test_routes_and_roles(spark):
    rows = spark.createDataFrame([("absolute", True), ("growth", False), ("entity", True)], "operation string, has boolean")
    assert [r.r for r in rows.select(retrieve.route(F.col("operation"), F.col("has")).alias("r")).collect()] == ["navigate", "search", "search"]
    docs = spark.createDataFrame([("q3-deck",), ("filing",)], "doc_id string")
    listing = retrieve.list_documents(docs, corpus.read_manifest(spark, None))
    assert [r.doc_id for r in retrieve.evidence_only(docs, listing).collect()] == ["filing"]
    key, schema = "run string, claim_index int", "run string, claim_index int, figures array<struct<raw:string,label:string,unit:string,period:string>>, doc_id string, node_ids array<string>, quote string"
    claims = spark.createDataFrame([("r", 0), ("r", 1)], key)
    findings = spark.createDataFrame([("r", i, [("12", "x", "", "")], d, ["n1"], "") for i, d in enumerate(("q3-deck", "filing"))], schema)
    fetched = spark.createDataFrame([("r", i, "12", "c", "") for i in (0, 1)], key + ", content string, cite string, unit string")
    got = validate.to_evidence(claims, findings, fetched, listing=listing).orderBy("claim_index").collect()
    assert [len(r.quantities) for r in got] == [0, 1] and len(validate.to_evidence(claims, findings, fetched).first().quantities) == 1
    assert spark.range(1).select(retrieve.truncated(F.lit("abcdef"), 4).alias("t")).first().t == "abcd"


def test_answers(spark):
    answers = {"<think>{a}</think> x {\"findings\": [{\"a\": 1}, 2]} tail": 1, "{\"findings\": [{\"a\": 1}]\"}": 1, "nothing": 0, None: 0, "{\"findings\": 3}": 0, "[1]": 0, "{broken \"findings\": [{\"b\": 2}, {\"b\": 3}] and": 2}
    got = validate.decode_findings(spark.createDataFrame([(str(i), a) for i, a in enumerate(answers)], "run string, content string")).groupBy("run").count().collect()
    assert {int(r.run): r["count"] for r in got} == {i: n for i, n in enumerate(answers.values()) if n}
    got = spark.createDataFrame([("<think>{no}</think> so {\"a\": {}} done",), ("none",)], "c string").select(validate.strip_answer(F.col("c")).alias("s")).collect()
    assert [r.s for r in got] == ["{\"a\": {}}", ""]


def test_claims(spark):
    claims = spark.createDataFrame([(1, 0, "$5"), (1, 1, "none"), (1, 2, "7%")], "request int, pos int, figure string")
    assert [r.pos for r in extract.requested(claims, 2).collect()] == [0]
    seen = spark.createDataFrame([(3, "growth"), (1, "absolute"), (5, "growth")], "pos int, operation string")
    assert [tuple(r) for r in report.operations_seen(seen, "pos").collect()] == [("absolute", 1, 1), ("growth", 3, 2)]
    later = spark.createDataFrame([(3,)], "pos int")
    assert {(r.operation, r.carried) for r in report.operations_seen(report.carried(seen, later, "pos"), "pos").collect()} == {("absolute", 0), ("growth", 1)}
    grouped = extract.in_groups(spark.range(57).select(F.col("id"), (F.col("id") % 2).alias("s")), "id", size=4, by="s", span=8).collect()
    assert all(r.group_no == r.id // 2 // 4 for r in grouped)
    assert [r.group_no for r in extract.in_groups(spark.range(30), "id", span=7).orderBy("id").collect()] == [i // 10 for i in range(30)]
    firsts = spark.createDataFrame([(2, "A  b"), (1, "a\u00a0B"), (3, None), (4, "")], "pos int, text string")
    assert sorted(r.pos for r in extract.first_wins(firsts, extract.claim_key(F.col("text")), "pos").collect()) == [1, 3]


def test_files(spark, tmp_path):
    wanted = spark.createDataFrame([("a",), ("b",)], "name string")
    assert [r.name for r in corpus.to_fetch(wanted, spark.createDataFrame([("a",)], "name string")).collect()] == ["b"]
    run = json.dumps({"model": "m", "seconds": 2.0, "claims": [{"text": "x", "status": "SUPPORTED"}, {"text": "y"}]})
    assert [(r.model, r.pos, r.text, r.status) for r in sinks.read_run(spark.createDataFrame([(run,)], "value string")).collect()] == [("m", 0, "x", "SUPPORTED"), ("m", 1, "y", None)]
    sinks.write_json(wanted, f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out").count() == 2
    docs = spark.createDataFrame([("a", 1), ("b", 2)], "doc_id string, n int")
    left = sinks.without_document(docs, spark.createDataFrame([("a",), ("z",)], "doc_id string"))
    assert [r.doc_id for r in left.collect()] == ["b"] and sinks.without_document(left, docs.filter("n = 1")).count() == 1


def brute_quotes(quotes, texts):
    squeeze = lambda t: " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789 " else " " for c in (t or "").lower()).split())
    return sorted({(q, k) for q, x in quotes for k, t in texts if len(squeeze(x).split()) >= 3 and squeeze(x) in squeeze(t)})


def test_quotes_meet_texts(spark, monkeypatch):
    texts = [(1, "The quick, brown fox jumps over!"), (2, "aquick brown foxy"), (3, None), (4, "one two three four"), (5, "xone two threex")]
    quotes = [(1, "quick brown fox"), (2, "the QUICK brown fox jumps over"), (3, "one two"), (4, "one two three"), (5, "two three four"), (6, None), (7, "quick brown fox jumps")]
    q, t = spark.createDataFrame(quotes, "quote_id int, text string"), spark.createDataFrame(texts, "key int, text string")
    assert sorted(map(tuple, containment.quotes_in_texts(q, t).collect())) == brute_quotes(quotes, texts)
    monkeypatch.setattr(containment, "small", lambda df: False)
    assert sorted(map(tuple, containment.quotes_in_texts(q, t).collect())) == brute_quotes(quotes, texts)


def test_words(spark):
    got = spark.createDataFrame([("A-b  c9",), (None,), ("é",)], "t string").select(g.words(F.col("t")).alias("w"), g.word_count(F.col("t")).alias("n")).collect()
    assert [(r.w, r.n) for r in got] == [(["a", "b", "c9"], 3), ([], 0), ([], 0)]


def test_odd_pages():
    deep = html_blocks.leaf_blocks("<div>" * 50_000 + "<p>x")
    assert [b["text"] for b in deep] == ["x"]
    grid = html_blocks.leaf_blocks('<table><tr><td colspan="\u00b2">a<td colspan=99999999>b</table>')[0]["grid"]
    assert [[(c["text"], c["colspan"]) for c in row] for row in grid] == [[("a", 1), ("b", 1000)]]
    assert html_blocks.leaf_blocks("<a " * 500_000) == [] and html_blocks.leaf_blocks("") == []
    assert [b["text"] for b in html_blocks.leaf_blocks("<p>1 &lt; 2<p title='a>b'>c</body><p>after")] == ["1 < 2", "c", "after"]


def brute_markdown(page):
    """A page without tables as lines, by plain rules over its leaf blocks."""
    out, anchors, last = [], {}, None
    for b in html_blocks.leaf_blocks(page or ""):
        text = b["text"]
        if b["kind"] == "anchor":
            last = text
            continue
        if not text or text.lower() == "table of contents" or (text.isascii() and text.isdigit() and len(text) < 4):
            continue
        numbered = re.match(r"(?i)(PART|ITEM)\s+[IVX0-9]", text)
        if len(text) <= 200 and (re.fullmatch("h[1-6]", b["tag"]) or numbered or b["bold"]):
            level = int(b["tag"][1]) if b["tag"][0] == "h" else 1 if re.match(r"(?i)PART\s+[IVX]+", text) else 2 if re.match(r"(?i)ITEM\s+\d", text) else 3
            out += ["", "#" * level + " " + text]
            if last:
                anchors[len(out)] = last
        else:
            out += ["", text]
    return "\n".join(out), anchors


def test_pages_as_markdown(spark):
    draw = random.Random(8)
    pieces = ["<p>", "</p>", "<div id=a1>", "</div>", "<h2 id=b>", "</h2>", "<b>", "</b>", "<span style='font-weight:700'>", "</span>", "Item 1. x", "PART II", "12", "text &amp; more ", "Table of Contents", "<li>", "<br>"]
    pages = ["".join(draw.choice(pieces) for _ in range(draw.randint(0, 25))) for _ in range(300)] + [None, ""]
    got = corpus.html_documents(spark.createDataFrame([(str(i), p, "") for i, p in enumerate(pages)], "doc_id string, html string, sha256 string")).collect()
    assert {int(r.doc_id): (r.markdown, r.anchors) for r in got} == {i: brute_markdown(p) for i, p in enumerate(pages)}


def test_statuses_by_window(spark):
    rows = spark.createDataFrame([("2024-01-01 00:00:10", "SUPPORTED"), ("2024-01-01 00:00:50", "SUPPORTED"), ("2024-01-01 00:01:10", "NO_SOURCE")], "t string, status string").select(F.to_timestamp("t").alias("ts"), "status")
    assert sorted((r.window.start.second, r.window.start.minute, r.status, r.n) for r in verify.statuses_by_window(rows, "1 minute").collect()) == [(0, 0, "SUPPORTED", 2), (0, 1, "NO_SOURCE", 1)]
