"""Spark-native engine for timestamped text: corpus to clean daily panel to statistics."""
