"""Functions of the change-bundle engine."""
