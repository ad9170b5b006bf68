"""Incremental summaries."""
