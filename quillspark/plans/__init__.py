"""Composite analyses and the query catalogue."""
