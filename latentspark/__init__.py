"""A PySpark-native engine for comparing and aligning embedding tables."""
