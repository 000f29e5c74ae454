"""Spark-native analytics for text, evaluation, retrieval and message data."""
