"""Tessara: a PySpark-native engine for match statistics and forecast queries."""

__version__ = "0.1.0"
