"""Spark-native package and prompt safety analytics."""
