"""Streaming of the change-bundle engine."""
