"""Corpus operators for training data: deduplication, classification, tokenisation, search and packing."""
