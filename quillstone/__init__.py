"""Spark-native evidence retrieval and context analytics."""
