"""Spark-native document-knowledge analytics."""
