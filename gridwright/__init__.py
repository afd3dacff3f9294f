"""Spark-native evaluation of table extraction from document pages under a compute budget."""
