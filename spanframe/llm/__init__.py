"""Operators for building training corpora from text and vectors."""
