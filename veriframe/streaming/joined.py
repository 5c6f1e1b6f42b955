"""Verdicts where claims and their evidence both arrive as streams.

Both sides wait in Spark's state for each other; the watermark says how long, and
what can no longer meet goes.  Nothing that was written is read again: repeats
are told by state, and the file sink's own log makes a replayed batch the same batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.compare import claim_defaults, decide

KEY = ("run_id", "claim_id")
SHOWN = ("run_id", "claim_id", "asked_at", "found_at", "status", "claimed", "actual", "claimed_basis", "actual_basis", "reason_code", "reason")


def verdict_stream(claims: DataFrame, evidence: DataFrame, late: str = "10 minutes", wait: str = "1 hour") -> DataFrame:
    """A verdict for each claim of a stream (run_id, asked_at and the claim) by the stream of evidence (run_id, found_at and the evidence).

    Evidence counts that is found within ``wait`` of its claim.  A claim comes out
    as soon as it meets evidence, or as one that has none once the watermark, which
    follows the slower stream by ``late``, has passed its time.  Of a claim's repeats, and of
    repeated evidence, the first counts while the watermark holds it.
    """
    c = claims.withWatermark("asked_at", late).dropDuplicatesWithinWatermark([*KEY]).alias("c")
    e = evidence.withWatermark("found_at", late).dropDuplicatesWithinWatermark([*KEY]).alias("e")
    same = (F.col("c.run_id") == F.col("e.run_id")) & (F.col("c.claim_id") == F.col("e.claim_id"))
    in_time = (F.col("e.found_at") >= F.col("c.asked_at")) & (F.col("e.found_at") <= F.col("c.asked_at") + F.expr(f"interval {wait}"))
    met = c.join(e, same & in_time, "leftOuter").select("c.*", "e.found_at", "e.quantities", "e.covered_periods", "e.doc_id", "e.node_ids", "e.citation_url", "e.quote")
    return decide(claim_defaults(met)).select(*SHOWN)


def start(claims: DataFrame, evidence: DataFrame, out: str, checkpoint: str, late: str = "10 minutes", wait: str = "1 hour") -> StreamingQuery:
    """Writes ``verdict_stream`` to Parquet files, each verdict once over restarts with the same checkpoint."""
    return verdict_stream(claims, evidence, late, wait).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
