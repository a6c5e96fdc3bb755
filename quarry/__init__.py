"""quarry: a PySpark-native engine for tables, property graphs and vectors."""

__version__ = "0.1.0"
