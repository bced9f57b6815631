"""Spark-native analytics for coordinated behaviour in message data."""

__version__ = "0.1.0"
