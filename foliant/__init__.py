"""foliant: a PySpark-native engine for personal document libraries."""
