"""Operators on graphs, responses and records."""
