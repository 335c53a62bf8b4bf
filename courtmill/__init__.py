"""Courtmill: a PySpark-native catalogue integration and retrieval engine."""

__version__ = "0.1.0"
