"""Text formats as tables."""
