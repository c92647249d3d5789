"""Spark-native operators for auditing what a text generator has taken from a corpus."""

__version__ = "0.1.0"
