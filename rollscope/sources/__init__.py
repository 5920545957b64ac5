"""sources of the last-name engine."""
