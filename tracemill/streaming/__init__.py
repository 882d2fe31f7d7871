"""Incremental scoring over arriving files."""
