"""Operators for training-data pipelines: tokens, quality, duplicates, leaks, secrets, pages, shuffling and packing."""
