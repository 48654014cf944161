"""Retrieval, evaluation and usage-log analytics as Spark DataFrame operators."""
