"""Spark-native crawl search and archive analytics."""

__version__ = "0.1.0"
