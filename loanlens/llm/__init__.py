"""Operators that prepare training text: scoring, deduplication, mixing, packing and formatting."""
