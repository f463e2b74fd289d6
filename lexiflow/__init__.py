"""Spark-first readability and text-analytics engine."""
