"""Spark-native analytics for governed document intelligence."""
