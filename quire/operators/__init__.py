"""Table operations."""
