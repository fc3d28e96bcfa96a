"""Sources of the analytics engine."""
