"""Spark-native upgrade-impact analytics."""
