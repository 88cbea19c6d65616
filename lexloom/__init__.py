"""Spark-first document analytics and retrieval over statute-like corpora."""
