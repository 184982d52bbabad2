"""Spark-native analytics over recorded market event streams."""

__version__ = "0.1.0"
