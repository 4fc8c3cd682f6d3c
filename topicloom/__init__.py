"""Spark-native analytics of text corpora and topic models."""
