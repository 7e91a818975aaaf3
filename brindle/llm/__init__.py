"""Training-data operators: packing, mixing, deduplication, formatting, WARC, scoring, sharding, quality.

Nothing else in the library imports this subpackage.
"""
