"""Quillmill: a PySpark-native engine for curating, graphing and scoring text corpora."""

__version__ = "0.1.0"
