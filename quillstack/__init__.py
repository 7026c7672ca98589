"""Structured-library analytics on PySpark."""
