"""functions of the signal engine."""
