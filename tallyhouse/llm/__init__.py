"""Operators for training-data pipelines: mixing, sharding, deduplication, filters, extraction, token files, search."""
