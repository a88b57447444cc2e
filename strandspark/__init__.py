"""Sequence-affinity analytics on Spark."""
