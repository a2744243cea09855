"""Incremental indexing as a stream."""
