"""Whether a table is small enough to be sent to every task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and bytes that are broadcast at most.
MOST_ROWS, MOST_BYTES = 100_000, 32 << 20


def small(table: DataFrame) -> bool:
    """Whether the table's rows, counted up to the bound, and their JSON stay within the bounds."""
    rows = table.limit(MOST_ROWS + 1).select(F.length(F.to_json(F.struct(*table.columns))).alias("b"))
    found = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    return found["n"] <= MOST_ROWS and found["b"] <= MOST_BYTES
