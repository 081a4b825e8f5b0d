"""Spark-native analytics over very large sparse count matrices and their metadata."""
