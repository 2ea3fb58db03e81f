"""Operators for preparing training text: cleaning, deduplicating, mixing, tokenising, searching."""
