"""Foliant: a full-text index and search engine expressed in PySpark DataFrames."""

__version__ = "0.1.0"
