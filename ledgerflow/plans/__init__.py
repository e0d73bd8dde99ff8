"""Plans of the change-bundle engine."""
