"""Training-data operators: quality, deduplication, tokens, archives, mixing, nearest neighbours."""
