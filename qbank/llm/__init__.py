"""Operators for preparing training data: near-duplicates, scans, counts, search and packing."""
