"""Operators of a training-data pipeline: sharding, deduplication, filtering, mixing and packing."""
