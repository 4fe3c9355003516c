"""Cubelark: a PySpark-native analytics engine for gridded, time-indexed data."""
