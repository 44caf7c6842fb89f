"""Training-data operators: deduplication, filtering, extraction, scoring and packing of text tables."""
