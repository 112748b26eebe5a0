"""Siltstone: chunk deduplication, similarity grouping and group compression on Spark."""
