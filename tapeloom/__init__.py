"""Spark-native price-bar analytics."""
