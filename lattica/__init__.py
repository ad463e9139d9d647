"""Lattica: a Spark-native analytics engine and join-order optimizer."""

__version__ = "0.1.0"
