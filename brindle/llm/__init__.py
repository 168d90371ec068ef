"""Operators for training-data pipelines: deduplication, filtering, encoding, mixing."""
