"""sources of the signal engine."""
