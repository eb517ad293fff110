"""Spark-first engine for content-addressed, versioned and erasure-coded data."""

__version__ = "0.1.0"
