import time

import duckdb
from pyspark.sql import functions as F

from veriframe.plans import catalog
from veriframe.sources import corpus

WRITTEN = [
    "<h1>a&amp;&amp;&amp; b&amp</h1>", '<h1>token = &quot;2abc&quot;</h1>', "<h1>a &lt; b &amp;amp; c</h1>", "<h1>a&#65;</h1>", "<h1><b>a</b> b</h1>", '<h1 class="x">a</h1>', "<H1>a</H1>", "<h1>a</h1><h1>b</h1>", "<h1>a<h1>b</h1>", "<h1>a",
    "<h1>a\nb</h1>", "<h1>x\n<h1>y</h1>", "</h1><h1>\n</h1><h1> z </h1>", "<h1></h1><h1>b</h1>", "<h1>a\rb\tc\x0cd\x0be</h1>", "<h1>  a　 b᠎  </h1>", "<h1>​﻿a\x1c\u0085</h1>", "<h1> é \U0001f600 </h1>", "", "x", None,
]


def test_titles_as_their_sql_has_them(spark, tmp_path):
    rows = list(enumerate(WRITTEN))
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    pages = duckdb.connect()
    pages.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(pages.execute(catalog.ORACLE_SQL["page_titles"]).fetchall())
    got = catalog.page_titles(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == want and len(want) == len(WRITTEN)
    blocks = corpus.page_blocks(spark.createDataFrame(rows[:2], "doc_id long, html string")).filter("tag = 'h1'")
    assert [r.text for r in blocks.orderBy("doc_id").collect()] == ["a&&& b&", 'token = "2abc"']


def test_unclosed_headings_take_linear_time(spark):
    page = spark.range(1).select(F.concat(F.repeat(F.lit("<h1>"), 400_000), F.lit("\n<h1>end</h1>")).alias("html"))
    began = time.time()
    assert page.select(corpus.written_heading(F.col("html")).alias("t")).first().t == "end"
    assert time.time() - began < 20
