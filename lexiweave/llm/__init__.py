"""Training-data operators: sharding, deduplication, tokens, fingerprints and more."""
