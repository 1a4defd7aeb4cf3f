"""Spark-first streaming of the engine."""
