"""Whole queries and the indexing plan."""
