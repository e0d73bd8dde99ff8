"""Replicated-change analytics expressed as Spark DataFrame operations."""
