"""Continuous refresh of a stored snapshot."""
