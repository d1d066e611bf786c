"""Spark-native analytics over research-literature records."""
