"""Spark-native statistical, time-series and risk analytics."""
