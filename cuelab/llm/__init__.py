"""Operators for training data: counts, packing, filters, extraction, duplicates, token files."""
