"""Composite pipelines and the registered query catalogue."""
