"""Operators of large-scale training-data pipelines, each usable on its own."""
