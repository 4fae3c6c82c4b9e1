"""lociframe: a PySpark-native engine for multi-string BWT indexing and k-mer analytics."""

__version__ = "0.1.0"
