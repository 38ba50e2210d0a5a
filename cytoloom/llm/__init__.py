"""Operators for large training-data corpora (texts in, one row per document out)."""
