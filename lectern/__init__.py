"""Lectern: a PySpark-native analytics engine for prose."""
