"""Spark-native log analytics."""
