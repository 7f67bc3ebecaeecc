"""Operators for large training-data pipelines (filters, dedup, packing, encoding)."""
