"""finweave: a PySpark-native engine for financial-crime analytics and data preparation."""

__version__ = "0.1.0"
