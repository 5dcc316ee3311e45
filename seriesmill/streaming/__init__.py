"""Streaming forms of the recursive operators."""
