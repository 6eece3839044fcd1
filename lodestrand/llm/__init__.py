"""Operators for large text corpora: quality, deduplication, archives, secrets, tokenization."""
