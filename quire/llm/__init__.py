"""Operators of a large training-data pipeline: counting, filtering, joining, encoding, packing and masking of text."""
