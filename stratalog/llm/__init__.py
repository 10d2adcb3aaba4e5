"""Operators for text corpora; the rest of the library doesn't use them."""
