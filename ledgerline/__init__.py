"""Spark-native, point-in-time market-regime and news-pressure analytics."""
