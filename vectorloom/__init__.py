"""Spark-native engine for Windows metafile collections and row-level analytics."""
