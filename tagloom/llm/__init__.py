"""Operators for training-data pipelines: search, filters, deduplication, mixing, sharding and packing."""
