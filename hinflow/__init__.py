"""Spark-native meta-path analytics."""
