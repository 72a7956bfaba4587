"""Spark-native analytics for genome rearrangements and copy numbers."""
