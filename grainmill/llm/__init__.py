"""Training-data operators: scoring, counting, mixing, packing, deduplication and search."""
