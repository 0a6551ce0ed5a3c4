"""Spark-native investigation analytics: every operator is a DataFrame-to-DataFrame function."""
