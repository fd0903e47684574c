"""Training-data operators: tokenising, sharding, scoring, near-duplicates, packing, filtering."""
