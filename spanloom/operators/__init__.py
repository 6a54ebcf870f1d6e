"""Operators on hits, tokens and edges."""
