"""Operators that prepare training data: filters, joins, deduplication, scoring, packing, search."""
