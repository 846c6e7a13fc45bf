"""Spark-native analytics over document corpora: lines, sentences, blocks, vectors, evidence, scores."""

__version__ = "0.1.0"
