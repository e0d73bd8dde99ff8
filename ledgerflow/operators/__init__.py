"""Operators of the change-bundle engine."""
