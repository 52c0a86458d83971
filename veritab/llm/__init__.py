"""Training-data operators: quality, tokens, dedup, joins, packing, formatting, search."""
