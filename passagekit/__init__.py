"""Retrieval analytics as PySpark DataFrame operators."""
