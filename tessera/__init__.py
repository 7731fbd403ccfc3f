"""Tessera: a Spark-native engine for interval, sparse-matrix and vector analytics."""

__version__ = "0.1.0"
