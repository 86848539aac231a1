"""Training-data operators: exact search, mixing, filtering, deduplication, tokenization and materialisation."""
