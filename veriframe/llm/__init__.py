"""Operators that a large-scale training-data pipeline needs, as Spark jobs."""
