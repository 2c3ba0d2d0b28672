"""Strataloom: Spark-native analytics over archived social content."""
