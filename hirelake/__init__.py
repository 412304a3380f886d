"""hirelake: a PySpark-native analytics engine for recruitment data."""

__version__ = "0.1.0"
