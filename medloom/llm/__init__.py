"""Operators for preparing training data from text, vectors, pages and conversations at scale."""
