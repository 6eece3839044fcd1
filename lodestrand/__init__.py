"""Spark-native engine for source text and relational records."""
