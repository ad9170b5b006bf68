"""Summaries, joins, tests and filters over calls."""
