"""Training-data operators: archives, scoring, filtering, deduplication, mixing and token output.

Nothing else in the library imports this subpackage.
"""
