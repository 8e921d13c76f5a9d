"""Operators of a training-data pipeline: deduplication, filters, extraction, encoding, search, placement."""
