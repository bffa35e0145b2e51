"""newsgrain: a PySpark-native engine for finding compact publishing episodes in large text corpora."""

__version__ = "0.1.0"
