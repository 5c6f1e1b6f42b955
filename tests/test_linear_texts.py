"""Operators over whole texts take time in proportion to their length."""

import time

import pytest

from veriframe.operators import containment, retrieve


def text(n):
    return " ".join(f"w{(i * 7919) % 5003}" for i in range(n))


def quotes(spark, rows):
    asked = spark.createDataFrame([(1, "w0 w2916 w829 w3745 w1658"), (2, "not there at all")], "quote_id int, text string")
    return containment.quotes_in_texts(asked, rows)


def search(spark, rows):
    return retrieve.bm25(spark.createDataFrame([(1, "w7 w11 w13 w4999"), (2, "")], "query_id int, text string"), rows, 3)


@pytest.mark.parametrize("use", [quotes, search])
def test_time_follows_length(spark, use):
    def took(n):
        rows = spark.createDataFrame([("a", text(n)), ("b", "w1 w2")], "key string, text string").coalesce(1)
        began = time.perf_counter()
        found = use(spark, rows).collect()
        assert found and {r.key for r in found} == {"a"}
        return time.perf_counter() - began

    took(2_000)
    short, long = min(took(20_000) for _ in range(2)), min(took(160_000) for _ in range(2))
    assert long < 12 * short  # eight times the words; in proportion to their square it would be 64 times


def test_postings(spark):
    rows = spark.createDataFrame([("a", "One two, two"), ("b", None), ("c", "three"), ("c", "three two")], "key string, text string")
    got = retrieve.postings(rows, spark.createDataFrame([("two",), ("three",), ("two",), ("gone",)], "term string")).collect()
    assert sorted((r.term or "", r.key, r.tf, r.total, r.length) for r in got) == [("", "a", 1, 3, 3), ("", "b", 1, 0, 0), ("", "c", 2, 3, 2), ("three", "c", 2, 3, 2), ("two", "a", 2, 6, 3), ("two", "c", 1, 2, 2)]


def test_best_of_many(spark):
    rows = [(q, k, float((k * 37 + q) % 101)) for q in range(3) for k in range(300)]
    got = sorted((r.q, r["rank"], r.key) for r in retrieve.best(spark.createDataFrame(rows, "q int, key int, score double"), "q", 4).collect())
    expected = [(q, i + 1, k) for q in range(3) for i, (_, k) in enumerate(sorted((-s, k) for p, k, s in rows if p == q)[:4])]
    assert got == expected
