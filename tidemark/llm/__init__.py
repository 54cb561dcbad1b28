"""Training-data operators: scoring, filtering, deduplication, mixing, packing and search.

Nothing outside this subpackage imports it; ``queries`` holds the registered queries.
"""
