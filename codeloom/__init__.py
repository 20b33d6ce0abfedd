"""codeloom: a PySpark-native analytics engine for property graphs of source code."""

__version__ = "0.1.0"
