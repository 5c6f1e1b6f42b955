"""Progress of runs over a stream of events."""

import datetime as dt

from veriframe.streaming import runs

SCHEMA = "run_id string, event_id string, at timestamp, kind string, claim_id long, total long"
AT = dt.datetime(2024, 3, 1, 9, 0)


class Feed:
    def __init__(self, spark, path):
        self.spark, self.path = spark, path

    def add(self, *events):
        rows = [(r, e, AT + dt.timedelta(minutes=m), kind, claim, total) for r, e, m, kind, claim, total in events]
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.path}/in")

    def run(self):
        events = self.spark.readStream.schema(SCHEMA).parquet(f"{self.path}/in")
        told = runs.progress(events, "5 minutes", 30)
        query = told.writeStream.format("parquet").option("path", f"{self.path}/out").option("checkpointLocation", f"{self.path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        got = self.spark.read.parquet(f"{self.path}/out").collect()
        return sorted((r.run_id, r.number, r.kind, r.claim_id, r.completed, r.remaining) for r in got)


def test_order_restart_and_silence(spark, tmp_path):
    feed = Feed(spark, f"file://{tmp_path}")
    # verdicts come before the start that is earlier than they are, and one of them twice
    feed.add(("a", "e3", 3, "verdict", 1, None), ("a", "e1", 1, "start", None, 2), ("a", "e2", 2, "note", None, None), ("a", "e3", 3, "verdict", 1, None), ("b", "f1", 2, "start", None, 3))
    feed.run()
    # after a restart: the rest of run a; run b says one thing and falls silent
    feed.add(("a", "e4", 5, "verdict", 2, None), ("a", "e5", 6, "end", None, None), ("b", "f2", 4, "verdict", 7, None), ("c", "g1", 20, "start", None, 1))
    feed.run()
    a = [("a", 1, "start", None, 0, 2), ("a", 2, "note", None, 0, 2), ("a", 3, "verdict", 1, 1, 1), ("a", 4, "verdict", 2, 2, 0), ("a", 5, "end", None, 2, 0)]
    feed.add(("c", "g2", 50, "verdict", 1, None))
    feed.run()
    feed.add(("c", "g3", 52, "end", None, None), ("d", "h1", 90, "start", None, 1))
    got = feed.run()
    b = [("b", 1, "start", None, 0, 3), ("b", 2, "verdict", 7, 1, 2), ("b", 3, "RUN_FAILED", None, 1, 2)]
    c = [("c", 1, "start", None, 0, 1), ("c", 2, "verdict", 1, 1, 0), ("c", 3, "end", None, 1, 0)]
    assert [x for x in got if x[0] != "d"] == sorted(a + b + c, key=lambda x: x[:2])
    assert feed.run() == got  # nothing new comes of a restart


def test_late_events_change_nothing(spark, tmp_path):
    feed = Feed(spark, f"file://{tmp_path}")
    feed.add(("a", "1", 0, "start", None, 1), ("z", "9", 40, "start", None, 1))
    feed.run()
    feed.add(("a", "2", 1, "verdict", 1, None), ("z", "8", 41, "verdict", 1, None))
    got = feed.run()
    assert [x for x in got if x[0] == "a" and x[2] == "verdict"] == []
