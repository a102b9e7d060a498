"""Spark-native analytics over application pipelines, practice logs and scored postings."""
