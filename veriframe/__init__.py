"""Claim verification and text pipelines as Spark jobs."""
