"""Operators that prepare training text: quality, deduplication, mixing, packing."""
