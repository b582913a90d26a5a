"""Training-data operators: deduplication, filtering, mixing, packing and formatting.

Nothing else in the library imports this subpackage.
"""
