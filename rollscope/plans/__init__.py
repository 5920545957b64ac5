"""plans of the last-name engine."""
