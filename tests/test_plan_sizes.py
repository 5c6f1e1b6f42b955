from veriframe.operators import retrieve, tree
from veriframe.operators.saved import saved
from veriframe.plans import catalog


def test_plans_over_section_trees_stay_small(spark, tmp_path, monkeypatch):
    """The driver holds each plan many times over while it is adapted: its memory follows the largest one."""
    sizes = []

    def lines(df):
        return len(df._jdf.queryExecution().sparkPlan().toString().split("\n"))

    def noted(df):
        sizes.append(lines(df))
        return saved(df)

    for module in (catalog, retrieve, tree):
        monkeypatch.setattr(module, "saved", noted)
    spark.createDataFrame([(k, k % 9 + 1) for k in range(1000, 1012)], "p_partkey long, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = catalog.evidence_path(spark, str(tmp_path))
    sizes.append(lines(found))
    assert max(sizes) < 300, sizes
    assert {r.claim_id % 6: r.status for r in found.collect()} == {0: "CONTRADICTED", 1: "SUPPORTED", 2: "NO_SOURCE", 3: "NO_SOURCE", 4: "NO_SOURCE", 5: "NO_SOURCE"}


def test_only_long_documents_are_split(spark):
    long = "\n".join(["# h", *["x" * 50] * 10, "# i", *["y" * 50] * 10])
    rows = [("long", long, None), ("paged", long, 1), ("short", "# s\n" + "z\n" * 8, None), ("edge", "# e\n" + "\n".join(["v" * 9] * 39) + "\n" + "v" * 6, None)]
    lines = spark.createDataFrame([(d, i + 1, x, None, p) for d, text, p in rows for i, x in enumerate(text.split("\n"))], "doc_id string, line_no int, text string, anchor string, page int")
    got = {}
    for r in tree.build_tree(lines, most_chars=400).collect():
        got.setdefault(r.doc_id, []).append((r.node_id, r.line_start, r.line_end))
    assert sorted(got["long"]) == [("n1", 1, 11), ("n1p1", 1, 6), ("n1p2", 7, 11), ("n2", 12, 22), ("n2p1", 12, 17), ("n2p2", 18, 22)]
    assert sorted(got["paged"]) == [("n1", 1, 11), ("n2", 12, 22)] and got["short"] == [("n1", 1, 10)]
    assert sorted(got["edge"]) == [("n1", 1, 41)]  # 400 characters, no more
    assert len(tree.build_tree(lines, most_chars=399).filter("doc_id = 'edge'").collect()) == 3
