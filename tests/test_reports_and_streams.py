import pytest
from pyspark.sql import functions as F

from veriframe.operators import extract, report
from veriframe.streaming import verify
from veriframe.types import CLAIMS, EVIDENCE, TAGGED_CLAIM


def test_claims_from_tags(spark):
    rows = [
        (0, "Revenue was $2.68 billion", "$2.68 billion", 2.68, "B", "USD", "absolute", "FY2024", ""),
        (1, "revenue  WAS $2.68 billion", "$9", 9.0, "", "USD", "growth", "", ""),
        (2, "Acme is a customer", "1", 1.0, "", "count", "entity", "", ""),
        (3, "none", "no digits", None, "", "", "absolute", "", ""),
        (4, "Margin 72%", "72%", None, "X", "percent", "count", "", "Results FY2023"),
        (5, "40 employees", "40 employees", 40.0, "", "people", "count", "", ""),
    ]
    got = extract.claims_from_tags(spark.createDataFrame(rows, f"pos int, {TAGGED_CLAIM}")).orderBy("claim_id").collect()
    assert [(r.claim_id, r.operation, r.value.value, r.value.scale, r.value.unit, r.period and r.period.year) for r in got] == [(0, "absolute", 2.68, 1e9, "USD", 2024), (4, "absolute", 72.0, 1.0, "percent", 2023), (5, "absolute", 40.0, 1.0, "count", None)]


def test_tags_from_text(spark):
    lines = [("d", 1, "# FY2024 results"), ("d", 2, "Revenue grew 26% year over year. GAAP operating income was $54 million.")]
    got = extract.tag_text(spark.createDataFrame(lines, "doc_id string, line_no int, text string")).orderBy("s", "f").collect()
    assert [(r.figure, r.operation, r.section, r.basis) for r in got] == [("26%", "growth", "FY2024 results", "GAAP"), ("$54 million", "absolute", "FY2024 results", "GAAP")]


def test_groups(spark):
    got = extract.in_groups(spark.range(23), "id").groupBy("group_no").count().orderBy("group_no").collect()
    assert [(r.group_no, r["count"]) for r in got] == [(0, 10), (1, 10), (2, 3)]


RUNS = [("a", 1, "SUPPORTED", "SUPPORTED", 5, "", "seeded: x"), ("a", 2, "NO_EVIDENCE", "BASIS_MISMATCH|NO_EVIDENCE", 5, "r", "ok"), ("a", 3, "CONTRADICTED", "SUPPORTED", 1, "", "ok"), ("b", 1, "RUN_FAILED", "SUPPORTED", 2, "", "seeded: x"), ("b", 2, "BASIS_MISMATCH", "BASIS_MISMATCH|NO_EVIDENCE", 2, "", "ok"), ("b", 3, None, "SUPPORTED", 2, None, "ok")]


def test_runs(spark):
    runs = spark.createDataFrame(RUNS, "model string, case int, status string, expected string, seconds int, rejected string, why string")
    assert [tuple(r) for r in report.leaderboard(runs).collect()] == [("a", 2, 3, 11, 5, 1, 0), ("b", 1, 3, 6, 2, 0, 1)]
    assert [r.case for r in report.missed_by_all(runs).collect()] == [3]
    assert tuple(report.wall_clock(runs).first()) == (17, 11)
    assert tuple(report.caught(runs).first()) == (1, 1, 2)
    assert tuple(report.tally(runs).first()) == (1, 2, 1, 2, 6)
    assert report.by_status(runs, "CONTRADICTED").count() == 2 and report.misses(runs).count() == 3
    assert [r.l for r in runs.limit(1).select(report.label(F.col("status")).alias("l")).collect()] == ["Supported"]


def test_tape(spark):
    events = spark.createDataFrame([("s", 1, "start"), ("s", 2, "verdict"), ("s", 3, "verdict"), ("t", 1, "start")], "run string, ts int, kind string")
    got = report.progress(report.event_tape(events, "run", "ts"), "run", "ts").orderBy("run", "ts").collect()
    assert [(r.seq, r.is_last, r.completed, r.remaining) for r in got] == [(1, False, 0, 2), (2, False, 1, 1), (3, True, 2, 0), (1, True, 0, 0)]


def test_stream_restarts(spark, tmp_path):
    value = (4.2, "USD", 1e6, ("FY", 2024, None, None, None, "FY2024"), "GAAP", "4.2")
    claim = lambda i: ("r", i, "t", value, "absolute", None, None)
    schema = f"run_id string, {CLAIMS}"
    evidence = spark.createDataFrame([(i, [(4_183_204.0, "USD", 1.0, value[3], "GAAP", "4,183,204")], [value[3]], "d", ["n"], "", "") for i in range(5)], EVIDENCE)
    where, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    spark.createDataFrame([claim(0), claim(1), claim(1)], schema).write.mode("append").parquet(where)
    verify.start(verify.read_claims(spark, where), evidence, out, f"file://{tmp_path}/c1").awaitTermination()
    spark.createDataFrame([claim(1), claim(2)], schema).write.mode("append").parquet(where)
    verify.start(verify.read_claims(spark, where), evidence, out, f"file://{tmp_path}/c2").awaitTermination()  # a lost checkpoint reads all again
    got = spark.read.parquet(out).collect()
    assert sorted((r.claim_id, r.status) for r in got) == [(0, "SUPPORTED"), (1, "SUPPORTED"), (2, "SUPPORTED")]


@pytest.mark.parametrize("text,n", [("GAAP", 1), ("$5", 1), ("zzz", 0)])
def test_claim_filter(spark, text, n):
    claims = spark.createDataFrame([("gaap income", "$5", "absolute"), ("other", "7%", "growth")], "text string, figure string, operation string")
    assert report.matching(claims, text=text).count() == n
