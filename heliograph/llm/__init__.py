"""Operators for training data: frequent items, history deduplication, tokens, mixtures, cut texts."""
