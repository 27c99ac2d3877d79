"""Training-data operators: mixing, filtering, scoring, deduplication and token output.

Nothing else in the library imports this subpackage; deleting it leaves the rest working.
"""
