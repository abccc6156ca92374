"""Spark-native analytics and retrieval engine for note corpora."""
