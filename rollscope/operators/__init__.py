"""operators of the last-name engine."""
