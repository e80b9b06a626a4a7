"""Training-data operators: search, packing, deduplication, quality, mixing, extraction."""
