"""operators of the signal engine."""
