"""plans of the signal engine."""
