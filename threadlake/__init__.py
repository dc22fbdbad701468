"""Incremental forum archives as Spark DataFrame jobs."""
