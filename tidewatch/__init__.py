"""Spark-native security event analytics."""

__version__ = "0.1.0"
