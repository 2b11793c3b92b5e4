"""Spark-native transaction-series monitoring operators."""
