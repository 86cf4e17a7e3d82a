"""Spark-native indoor-localization analytics."""
