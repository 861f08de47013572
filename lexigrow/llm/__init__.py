"""Operators for training-data pipelines over ``documents``-shaped tables.

Nothing outside this subpackage imports it; ``registry`` holds its queries.
"""
