"""Operators over texts, source files and vectors for training-data pipelines."""
