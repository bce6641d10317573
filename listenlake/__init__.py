"""Spark-native analytics for music-listening data."""
