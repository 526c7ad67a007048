"""scriptorium: a PySpark-native engine for building, querying and maintaining a text corpus."""

__version__ = "0.1.0"
