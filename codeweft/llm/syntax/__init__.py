"""Recursive-descent parsers that tell whether a source text is valid, and collect all its errors."""
