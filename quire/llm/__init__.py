"""Training-data operators: deduplication, mixing, packing, scoring and search.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; ``queries`` holds the thin registered queries.
"""
