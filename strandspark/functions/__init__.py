"""Alphabets, the window kernel and SQL functions."""
