"""functions of the last-name engine."""
