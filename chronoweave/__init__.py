"""A Spark-native engine for typed, ordered time-series tables."""
