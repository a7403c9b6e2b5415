"""Corpus-building operators for large training sets (one module per operator)."""
