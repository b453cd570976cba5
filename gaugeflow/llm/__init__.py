"""Operators for large text corpora: cleaning, deduplication, scoring, packing and formatting of training data."""
