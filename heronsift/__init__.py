"""Spark-native retrieval, retrieval evaluation and corpus processing."""
