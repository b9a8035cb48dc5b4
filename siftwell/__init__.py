"""siftwell: a PySpark-native engine for preparing, scoring and summarising training data."""
