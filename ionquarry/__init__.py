"""Spark-native analytics for mass-spectrometry data."""
