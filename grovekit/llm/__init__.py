"""Training-data pipeline operators: deduplication, quality, tokenization, packing and media columns."""
