"""Operators for preparing training text at scale (deduplication, filters, tokenizing)."""
