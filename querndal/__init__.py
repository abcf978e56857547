"""Spark-native engine for retrieval, ingestion and evaluation analytics over text stores."""
