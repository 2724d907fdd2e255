"""streaming of the signal engine."""
