"""Sources of the change-bundle engine."""
