"""Terrane: a PySpark-native engine for worlds of tagged geographic features."""
