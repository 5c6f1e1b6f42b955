"""Digests of section trees over two snapshots."""

import pytest

from veriframe.operators import snapshots, tree
from veriframe.plans import catalog


@pytest.fixture(scope="module")
def docs(spark):
    return catalog.outlines(spark, "/root/testdata/sf0.001").filter("try_cast(doc_id as int) < 25").cache()


def told(docs):
    lines = tree.lines_of(docs)
    return snapshots.digests(tree.build_tree(lines, min_lines=1), lines)


def test_one_line_changes_its_way_to_the_root(spark, docs):
    rows = docs.collect()
    some = max(rows, key=lambda r: len(r.markdown.split("\n")))
    lines = some.markdown.split("\n")
    at = next(i for i in range(len(lines) - 1, 0, -1) if not lines[i].startswith("#"))
    lines[at] += " and more"
    edited = spark.createDataFrame([r if r.doc_id != some.doc_id else (*r[:2], "\n".join(lines), *r[3:]) for r in rows], docs.schema)
    nodes = tree.build_tree(tree.lines_of(docs), min_lines=1).filter(f"doc_id = '{some.doc_id}'").collect()
    inside = sorted((n for n in nodes if n.line_start <= at + 1 <= n.line_end), key=lambda n: n.ord)
    got = snapshots.changes(told(docs), told(edited)).collect()
    assert sorted((r.doc_id, r.node_id, r.change, r.own_changed) for r in got) == sorted((some.doc_id, n.node_id, "changed", n is inside[-1]) for n in inside)
    # what is kept of the summaries is all but these
    before = told(docs)
    known = before.selectExpr("digest", "concat('about ', path) as summary")
    left = snapshots.with_kept_summaries(told(edited), known).filter("summary is null").collect()
    assert {(r.doc_id, r.node_id) for r in left} == {(some.doc_id, n.node_id) for n in inside}


def test_same_titles_new_and_lost_sections(spark):
    make = lambda text: spark.createDataFrame([("a", "md", text, {}, {})], "doc_id string, doc_type string, markdown string, anchors map<int,string>, pages map<int,int>")
    before, after = make("# A\nx\n# B\none\n# B\ntwo"), make("# New\nn\n# A\nx\n# B\none\n## C\nin\n# B\ntwo")
    got = sorted((r.path, r.nth, r.change, r.own_changed) for r in snapshots.changes(told(before), told(after)).collect())
    assert got == [("B", 1, "changed", False), ("B › C", 1, "added", True), ("New", 1, "added", True)]
    assert [(r.path, r.change) for r in snapshots.changes(told(after), told(make("# A\nx"))).orderBy("path", "nth").collect()] == [("B", "removed"), ("B", "removed"), ("B › C", "removed"), ("New", "removed")]
    assert snapshots.changes(told(before), told(before)).count() == 0


def test_documents_of_equal_bytes_are_not_read(spark):
    before = spark.createDataFrame([("a", "1"), ("b", "2")], "doc_id string, sha256 string")
    after = spark.createDataFrame([("a", "1", "x"), ("b", "3", "y"), ("c", "1", "z")], "doc_id string, sha256 string, more string")
    assert sorted(r.doc_id for r in snapshots.changed_documents(before, after).collect()) == ["b", "c"]
