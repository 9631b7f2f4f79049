"""A PySpark-native engine for hierarchical tables: structure, text, retrieval and evaluation."""
