"""Corpus operators: mixing, filtering, deduplication, fingerprints, media columns and packing."""
