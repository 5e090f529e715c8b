"""Composed plans and registered queries."""
