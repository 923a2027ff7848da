"""Spark-native engine for structured, multilingual text corpora."""
