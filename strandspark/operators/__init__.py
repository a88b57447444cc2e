"""Relational operators over sequences and count tables."""
