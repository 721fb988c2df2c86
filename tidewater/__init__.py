"""Tidewater: Spark-native data quality, record linkage and text-corpus operators."""

__version__ = "0.1.0"
