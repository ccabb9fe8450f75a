"""Spark-native engine for building, cleaning and querying a corpus of research papers."""
