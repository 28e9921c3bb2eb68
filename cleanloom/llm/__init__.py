"""Corpus operators for large-scale training data, their queries and their SQL."""
