"""Operators that prepare training text: dedup, packing, filtering, scoring, mixing."""
