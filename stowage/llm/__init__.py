"""Operators for large training-text tables (mixing, tokenising, dedup, scoring).

Nothing outside this subpackage imports it.
"""
