"""Spark-native word-association analytics and training-data preparation."""

__version__ = "0.1.0"
