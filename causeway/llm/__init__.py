"""Operators for training-data pipelines: filters, deduplication, search and tokenization."""
