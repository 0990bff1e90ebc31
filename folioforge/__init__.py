"""A PySpark-native corpus engine."""
