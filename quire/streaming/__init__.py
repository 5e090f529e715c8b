"""Streaming forms of the table operations."""
