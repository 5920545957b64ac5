"""streaming of the last-name engine."""
