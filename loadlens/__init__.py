"""Spark-native analytics over load measurements of text-generation endpoints."""

__version__ = "0.1.0"
