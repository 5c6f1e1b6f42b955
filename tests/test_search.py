import duckdb
import pytest

from veriframe.operators import retrieve
from veriframe.plans import catalog


def shuffled_rows(spark):
    """Rows that all stages so far have written for others."""
    jvm = spark.sparkContext._jvm
    store = spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}


def test_texts_times_queries_are_not_shuffled(spark):
    texts = spark.createDataFrame([(k, " ".join(f"w{(k + i) % 12}" for i in range(10))) for k in range(1500)], "key long, text string").repartition(3)
    asked = spark.createDataFrame([(q, " ".join(f"w{i}" for i in range(12)) + f" q{q}") for q in range(40)], "query_id int, text string")
    before = shuffled_rows(spark)
    found = retrieve.bm25(asked, texts, 5).collect()
    after = shuffled_rows(spark)
    assert len(found) == 40 * 5
    moved = sum(n for at, n in after.items() if at not in before)
    assert moved < 0.8 * 1500 * 40, moved  # a row for each text and query would be 60,000


@pytest.mark.parametrize("broadcast", [True, False])
def test_search_as_its_sql_has_it(spark, tmp_path, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(retrieve, "small", lambda table: False)
    monkeypatch.setattr(retrieve, "MET_IN_TASK", 50)
    texts = [" ".join(f"w{(i * i + 3 * k) % 17}" for i in range(k % 23)) + (" The, the A1!" if k % 4 else "") for k in range(80)] + [None, "", "w1 w1", "w1 w1"]
    asked = ["w1 w2 w3", "w3  w2 w1 w1", "W1, w2; w3", "the a1", "", None, "nowhere", "w5 w9 w9"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(asked)), "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(db.execute(catalog.ORACLE_SQL["bm25_topk"]).fetchall())
    assert sorted(map(tuple, catalog.bm25_topk(spark, str(tmp_path)).collect())) == want and len(want) > 20


def test_scores_round_as_in_sql(spark):
    scores = [197.25435, 24.64625, 0.00005, 1.00005, 2.675, 1e-9, 0.0, 123456.78905, 39.45085000000001] + [k / 8000 + 0.00005 for k in range(400)]
    want = [x for (x,) in duckdb.execute("SELECT round(round(x, 6), 4) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [scores]).fetchall()]
    rows = spark.createDataFrame(list(enumerate(scores)), "i int, x double")
    got = rows.select("i", retrieve.rounded(retrieve.rounded(rows.x, 6), 4).alias("y")).orderBy("i").collect()
    assert [r.y for r in got] == want
