"""Verdicts over a stream of claims, with restart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.compare import verdicts
from ..types import CLAIMS

OUT = ["run_id", "claim_id", "status", "claimed", "actual", "claimed_basis", "actual_basis", "reason_code", "reason"]


def read_claims(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of claims with run_id from Parquet files as they arrive."""
    return spark.readStream.schema(f"run_id string, {CLAIMS}").parquet(folder)


def unfinished(claims: DataFrame, done: DataFrame) -> DataFrame:
    """Claims whose verdict is not among those done."""
    return claims.join(done.select("run_id", "claim_id"), ["run_id", "claim_id"], "left_anti")


def _known(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_known_schema()).parquet(path)


def start(claims: DataFrame, evidence: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes a verdict for each claim of the stream to ``out``, once, whatever is read again after a restart."""
    spark = claims.sparkSession
    spark.createDataFrame([], _known_schema()).write.mode("append").parquet(out)

    def batch(rows: DataFrame, _: int) -> None:
        fresh = unfinished(rows.dropDuplicates(["run_id", "claim_id"]), _known(spark, out))
        verdicts(fresh, evidence).select(*OUT).write.mode("append").parquet(out)

    return claims.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _known_schema() -> str:
    return "run_id string, claim_id bigint, status string, claimed double, actual double, claimed_basis string, actual_basis string, reason_code string, reason string"


def statuses_by_window(events: DataFrame, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Events (ts, status) counted by time window, with late ones up to a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "status").agg(F.count("*").alias("n"))
