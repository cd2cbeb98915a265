"""Spark-native corpus, code-index and retrieval analytics."""
