"""Spark-first analytics for document pages, text regions and usage records."""
