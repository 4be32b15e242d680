"""Operators of a training-data pipeline: filtering, deduplication, tokenising, packing, formatting."""
