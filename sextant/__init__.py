"""Sextant: a Spark-native engine for building and evaluating text retrieval pipelines."""
