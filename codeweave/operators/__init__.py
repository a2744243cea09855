"""Relational and graph operators on the tables of an index."""
