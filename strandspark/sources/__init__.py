"""Readers and writers of sequence, count-table and model files."""
