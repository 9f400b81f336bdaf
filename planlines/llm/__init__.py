"""Operators for large training corpora: each maps DataFrames to DataFrames and runs as Spark jobs."""
