"""Training-data operators: scoring, cleaning, deduplication, mixing, tokenising and archiving.

Nothing else in the library imports this subpackage.
"""
