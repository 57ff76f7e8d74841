"""Spark-native survey analytics: DataFrame operators, sources, functions and query plans."""
