"""Operators for building training text at scale: archives, dialogue, deduplication, rules, mixing and packing."""
