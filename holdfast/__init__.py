"""Spark-first hybrid search, library analytics and corpus preparation."""

__version__ = "0.1.0"
