"""Spark-native hybrid retrieval analytics."""
