"""Tessera: a Spark-native engine for market and news analytics."""

__version__ = "0.1.0"
