"""Operators for preparing text corpora: tokenizing, near-duplicates, extraction, filters, mixing, search.

Nothing else in the library imports this subpackage.
"""
