"""Spark-native analytics over snapshot-keyed architecture facts."""
