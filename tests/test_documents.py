import random

from pyspark.sql import functions as F

from veriframe.operators import retrieve, tree
from veriframe.sources import corpus, sinks

PAGE = """<html><body><div id="top"><p><b>PART I</b></p><p>Plain text here.</p><p>Table of Contents</p><p>12</p>
<h2 id="item7">Item 7. Results</h2><div>lost text<p>one</p><p>two<p>three</div>
<table><tr><td colspan=3>(in thousands)</td></tr><tr><td>Revenue</td><td>$</td><td>2,684</td><td></td></tr><tr><td>Loss</td><td>$</td><td>( 12 )</td><td></td></tr></table>
<p style="font-weight:bold">Short bold</p></div></body></html>"""


def docs(spark, **texts):
    none = (F.create_map().cast("map<int,string>"), F.create_map().cast("map<int,int>"))
    return spark.createDataFrame(list(texts.items()), "doc_id string, markdown string").select("doc_id", F.lit("md").alias("doc_type"), "markdown", none[0].alias("anchors"), none[1].alias("pages"), F.lit("").alias("sha256"))


def test_html(spark):
    got = corpus.html_documents(spark.createDataFrame([("p", PAGE, "s"), ("e", "", "s"), ("n", None, "s")], "doc_id string, html string, sha256 string"))
    by = {r.doc_id: r for r in got.collect()}
    lines = by["p"].markdown.split("\n")
    assert lines[:4] == ["", "# PART I", "", "Plain text here."]
    assert "## Item 7. Results" in lines and "one" in lines and "two" in lines and "three" in lines and "lost text" not in by["p"].markdown and "12" not in lines
    assert "### Short bold" in lines and "| (in thousands) Revenue$ | (in thousands) 2,684 |" in lines and "| Loss$ | (12) |" in lines
    assert by["p"].anchors[lines.index("## Item 7. Results") + 1] == "item7" and by["p"].anchors[2] == "top"
    assert by["e"].markdown == "" and by["n"].markdown == ""


def test_table_collapse(spark):
    cell = "array<array<struct<text:string,colspan:int>>>"
    grid = [[("", 1), ("Year Ended", 2)], [("", 1), ("2024", 1), ("2023", 1)], [("Cost | x", 1), ("1", 1), ("2", 1)]]
    got = spark.createDataFrame([(grid,), ([],), ([[("", 1)]],)], f"g {cell}").select(corpus.table_markdown(F.col("g")).alias("t")).collect()
    assert got[0].t.split("\n") == ["|  | Year Ended 2024 | Year Ended 2023 |", "| --- | --- | --- |", "| Cost \\| x | 1 | 2 |"]
    assert got[1].t == "" and got[2].t == ""


def brute_tree(lines):
    """Parents, ends and kept headings by walking a stack."""
    heads = [(i + 1, len(x) - len(x.lstrip("#")), x.lstrip("#").strip()) for i, x in enumerate(lines) if x.startswith("#")]
    out, stack = [], []
    for k, (line, level, title) in enumerate(heads):
        while stack and heads[stack[-1]][1] >= level:
            stack.pop()
        end = next((h[0] - 1 for h in heads[k + 1 :] if h[1] <= level), len(lines))
        out.append([k + 1, (stack[-1] + 1) if stack else 0, title, line, end])
        stack.append(k)
    kept = set()
    for n in reversed(out):
        if any(m[1] == n[0] for m in out if m[0] in kept) or n[4] - n[3] >= 6 or n[2].upper().startswith(("ITEM ", "PART ")):
            kept.add(n[0])
    return [(f"n{n[0]}", f"n{n[1]}" if n[1] else "root", n[2], n[3], n[4]) for n in out if n[0] in kept]


def test_trees(spark):
    draw = random.Random(3)
    texts = {f"d{k}": "\n".join(("#" * draw.randint(1, 6) + draw.choice([" s", " Item 1", " part x"]) + str(i)) if draw.random() < 0.3 else "text" for i in range(draw.randint(1, 60))) for k in range(25)}
    texts = {k: v if "#" in v else v + "\n# s" for k, v in texts.items()}
    nodes = tree.build_tree(tree.lines_of(docs(spark, **texts)))
    got = sorted((r.doc_id, r.node_id, r.parent_id, r.title, r.line_start, r.line_end) for r in nodes.collect())
    assert got == sorted((k, *n) for k, v in texts.items() for n in brute_tree(v.split("\n")))


def test_single_and_split(spark):
    d = docs(spark, plain="a\nb", big="\n".join(["# h", *["x" * 50] * 20]))
    nodes = tree.build_tree(tree.lines_of(d), most_chars=400)
    got = {(r.doc_id, r.node_id): (r.parent_id, r.title, r.line_start, r.line_end) for r in nodes.collect()}
    assert got["plain", "n1"] == ("root", "plain", 1, 2)
    assert [got["big", f"n1p{i}"] for i in (1, 2, 3)] == [("n1", "h (part 1)", 1, 7), ("n1", "h (part 2)", 8, 14), ("n1", "h (part 3)", 15, 21)]
    assert {r.node_id: r.path for r in tree.paths(nodes).collect()}["n1p2"] == "h › h (part 2)"
    assert [r.node_id for r in tree.trimmed(nodes.filter("doc_id = 'big'"), 1).collect()] == ["n1"]


def test_content(spark):
    d = docs(spark, a="# One\n" + "\n".join("line" for _ in range(8)) + "\n## Two\n" + "\n".join("more" for _ in range(8)))
    nodes = retrieve.addressed(d)
    manifest = spark.createDataFrame([("a", None, "10-K", None, "http://u")], "doc_id string, role string, type string, period string, url string")
    asked = spark.createDataFrame([(1, "a", ["n2", "n1"]), (2, "a", ["n1", "n9"]), (3, "a", ["root"])], "request int, doc_id string, node_ids array<string>")
    rows = retrieve.content(asked, nodes, d, manifest).orderBy("request", "pos").collect()
    assert [(r.request, r.node_id, r.path, r.cite) for r in rows] == [(1, "n2", "One › Two", "http://u"), (1, "n1", "One", "http://u"), (3, "root", "", "http://u")]
    assert rows[0].content == "\n".join(["## Two", *["more"] * 8]) and rows[1].content.startswith("# One") and rows[1].content.endswith("more")


def test_pages_and_formats(spark, tmp_path):
    for name, data in {"x.md": b"# T\n\xff", "y.html": PAGE.encode(), "z.pdf": b"%PDF", "w.bin": b"1", "x.txt": b"t"}.items():
        (tmp_path / name).write_bytes(data)
    found = corpus.files(spark, f"file://{tmp_path}")
    assert sorted((r.doc_id, r.ext) for r in corpus.listed(found).collect()) == [("x", "md"), ("y", "html"), ("z", "pdf")]
    kinds = {(r.doc_id, r.doc_type) for r in corpus.load(found).collect()}
    assert kinds == {("x", "md"), ("y", "html"), ("z", "unsupported"), ("w", "unsupported")}
    pdf = lambda f: f.select("doc_id", F.explode(F.array(F.struct(F.lit(1).alias("page"), F.lit(" a \nb").alias("text")), F.struct(F.lit(2).alias("page"), F.lit("c").alias("text")))).alias("p")).select("doc_id", "p.*")
    got = corpus.load(found, pdf).filter("doc_id = 'z'").first()
    assert got.markdown.split("\n") == ["# Page 1", "a", "b", "", "# Page 2", "c", ""] and got.pages == {1: 1, 2: 1, 3: 1, 5: 2, 6: 2}
    status = {r.ext: (r.status, r.reason) for r in corpus.accept_uploads(found).collect()}
    assert status["bin"] == ("rejected", "unsupported format bin") and status["md"][0] == "accepted"


def test_feeds(spark):
    feed = '{"filings":{"recent":{"form":["8-K","10-K","8-K"],"filingDate":["1","2","3"],"reportDate":["2025","2024-12","2024"],"accessionNumber":["a","b","c"],"primaryDocument":["p","q","r"]}}}'
    rows = corpus.filings(spark.createDataFrame([(feed,)], "content string"))
    assert corpus.first_filing(rows, "10-K", "2024").first().primaryDocument == "q"
    page = '<tr><td>1</td><td>x</td><td><a href="/d/deck.htm">f</a></td><td> EX-99.1 </td></tr><tr><td>1</td><td>x</td><td><a href="/d/deck.PDF">f</a></td><td>EX-99.1</td></tr><tr><td>no</td></tr>'
    listing = corpus.filing_documents(spark.createDataFrame([("c", page), ("a", "<tr></tr>")], "accession string, html string"))
    assert tuple(corpus.find_deck(rows, listing).first()) == ("c", "deck.PDF", True)


def test_frames(spark):
    row = spark.range(1).select(sinks.sse_frame(F.lit("verdict"), F.struct(F.lit(1).alias("a"))).alias("f")).select("f", sinks.parse_sse(F.concat("f", "f", F.lit("event: cut"))).alias("p")).first()
    assert row.f == 'event: verdict\ndata: {"a":1}\n\n' and [tuple(x) for x in row.p] == [("verdict", '{"a":1}')] * 2


def test_pages_of_sections_by_brute_force(spark):
    rng = random.Random(8)
    lines, nodes = [], []
    for d in range(12):
        n, page = rng.randrange(1, 60), 1
        for i in range(1, n + 1):
            page += rng.random() < 0.2
            lines.append((str(d), i, None, None if rng.random() < 0.2 or d == 3 else page))
        for k in range(8):
            a = rng.randrange(1, n + 1)
            nodes.append((str(d), f"n{k}", a, rng.randrange(a, n + 1)))
    got = tree.with_addresses(spark.createDataFrame(nodes, "doc_id string, node_id string, line_start int, line_end int"), spark.createDataFrame(lines, "doc_id string, line_no int, anchor string, page int"))
    expected = []
    for d, k, a, b in nodes:
        spans = {}
        for doc, i, _, p in lines:
            if doc == d and p:
                lo, hi = spans.get(p, (i, i))
                spans[p] = min(lo, i), max(hi, i)
        held = [p for p, (lo, hi) in spans.items() if lo <= b and hi >= a]
        expected.append((d, k, min(held, default=None), max(held, default=None)))
    assert sorted(tuple(r) for r in got.select("doc_id", "node_id", "page_start", "page_end").collect()) == sorted(expected)
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_references_that_go_in_circles(spark):
    rng = random.Random(2)
    edges = [(d, f"s{rng.randrange(9)}", f"s{rng.randrange(9)}") for d in "abc" for _ in range(11)] + [("a", "s1", None)]
    got = tree.note_reach(spark.createDataFrame(edges, "doc_id string, node_id string, note_node string")).collect()
    expected = []
    for d in "abc":
        step = {}
        for doc, x, y in edges:
            if doc == d and y:
                step.setdefault(x, set()).add(y)
        for start in step:
            seen, now, hops = {}, {start}, 0
            while now:
                hops += 1
                now = {y for x in now for y in step.get(x, ())} - set(seen)
                seen |= dict.fromkeys(now, hops)
            expected += [(d, start, y, h) for y, h in seen.items()]
    assert sorted(map(tuple, got)) == sorted(expected)
    assert tree.note_reach(spark.createDataFrame([], "doc_id string, node_id string, note_node string")).count() == 0
