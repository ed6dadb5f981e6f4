"""Operators for building training corpora from large document tables."""
