"""Spark-native retrieval, rank-fusion and evaluation engine."""

__version__ = "0.1.0"
