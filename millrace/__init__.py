"""Spark-native curation of request/answer corpora and analytics of model routing."""
