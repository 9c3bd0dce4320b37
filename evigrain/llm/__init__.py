"""Operators for preparing training data: deduplication, filters, mixing, formatting."""
