"""Spark-native delta engine for versioned property graphs."""
