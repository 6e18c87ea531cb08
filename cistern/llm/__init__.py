"""Operators for training-data pipelines: archives, tokens, near copies, leaks, toxicity, quality, extraction, shards."""
