"""Spark-native analytics for multi-station environmental time series."""

__version__ = "0.1.0"
