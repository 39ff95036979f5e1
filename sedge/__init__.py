"""sedge: a PySpark-native analytics engine with a small-database SQL dialect."""

__version__ = "0.1.0"
