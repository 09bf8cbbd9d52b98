"""Training-data operators: filtering, encoding, deduplication, scoring and packing of text corpora."""
