"""Spark-native analytics for time-of-flight transmission imaging."""
