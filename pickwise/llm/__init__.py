"""Operators for preparing training text: extraction, filtering, near-copies, search, mixing, packing, encoding."""
