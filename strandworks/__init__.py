"""Spark-first analytics over position-by-feature tables and similar grouped, ordered data."""
