"""Spark-native sequence analytics: DataFrame operators for short-read data."""
