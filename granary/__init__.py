"""Granary: a PySpark-native engine for agricultural data processing."""
