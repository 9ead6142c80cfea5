"""Loomspark: a PySpark-native engine for candidate discovery and ranking."""

__version__ = "0.1.0"
