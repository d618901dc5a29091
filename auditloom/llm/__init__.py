"""Operators for building training corpora: de-duplication, quality, mixing, tokens, search."""
