"""Spark-native preparation and evaluation of text-retrieval corpora."""

__version__ = "0.1.0"
