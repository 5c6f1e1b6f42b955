"""Uploads that stream into the index."""

from veriframe.streaming import uploads


def test_uploads(spark, tmp_path):
    folder, out = tmp_path / "in", f"file://{tmp_path}/out"
    folder.mkdir()

    def put(**files):
        for name, content in files.items():
            (folder / name.replace("_", ".")).write_bytes(content)

    def run(checkpoint="c"):
        uploads.start(spark, f"file://{folder}", out, f"file://{tmp_path}/{checkpoint}", "http://x/").awaitTermination()
        docs = {r.doc_id: r.markdown for r in uploads.current(spark, out, "documents").collect()}
        nodes = sorted((r.doc_id, r.title) for r in uploads.current(spark, out, "nodes").collect())
        urls = {r.doc_id: r.url for r in uploads.current(spark, out, "manifest").collect()}
        return docs, nodes, urls

    long = b"\n".join(b"line %d" % i for i in range(9))
    put(a_md=b"# One\n" + long, b_html=b"<html><body><h1>Two</h1><p>text</p></body></html>", c_exe=b"x", d_md=b"", e_pdf=b"%PDF")
    docs, nodes, urls = run()
    assert set(docs) == {"a", "b"} == set(urls) and ("a", "One") in nodes and urls["b"] == "http://x/b.html"
    told = {r.name: (r.status, r.reason) for r in spark.read.parquet(f"{out}/uploads").collect()}
    assert told["a.md"] == ("accepted", "") and told["c.exe"] == ("rejected", "unsupported format exe") and told["e.pdf"][0] == "rejected"
    # a lost checkpoint reads all again: nothing changes
    assert run("other") == (docs, nodes, urls)
    assert {r.status for r in spark.read.parquet(f"{out}/uploads").filter("name = 'a.md'").collect()} == {"accepted", "unchanged"}
    # a new file of a name replaces document, sections and entry; others stay
    (folder / "a.md").unlink()
    put(a_txt=b"# Other\n" + long)
    docs, nodes, urls = run("other")
    assert docs["a"].startswith("# Other") and "b" in docs and urls["a"] == "http://x/a.txt"
    assert ("a", "Other") in nodes and ("a", "One") not in nodes


def test_a_batch_done_again_replaces_itself(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    uploads.prepare(spark, out)
    rows = spark.createDataFrame([("a", "md", bytearray(b"# T\nx"), "s1", "/in/a.md")], "doc_id string, ext string, content binary, sha256 string, path string")
    for _ in range(2):
        uploads.ingest(rows, "q-5", out)
        assert uploads.current(spark, out, "documents").count() == 1 and uploads.current(spark, out, "uploads").count() == 1
