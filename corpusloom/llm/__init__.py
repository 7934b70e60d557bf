"""Operators for large training-text collections.

Nothing outside this subpackage imports it; ``llm.queries`` holds its registered queries.
"""
