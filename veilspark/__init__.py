"""Spark-native clinical text de-identification engine."""

__version__ = "0.1.0"
