"""Training-data operators: dedup, joins, tokens, packing, scoring and storage. Nothing else in the library imports this."""
