"""Operators for preparing training data: splitting, packing, mixing, deduplication, similarity, ranking, residue.

Nothing outside this subpackage imports it.
"""
