"""Operators for training-data pipelines: deduplication, quality, tokens, packing, sharding, captures."""
