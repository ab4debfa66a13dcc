"""A PySpark-native engine for leakage-safe ranking of prospects from season-level data."""
