"""Spark-native analytics for financial time series."""
