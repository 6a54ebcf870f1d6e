"""Spark-native token-pattern extraction over annotated sentences."""

__version__ = "0.1.0"
