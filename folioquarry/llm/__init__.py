"""Operators for preparing training data: dedup, decontamination, filtering, tokenising, sharding, search.

Nothing else in the library imports this subpackage.
"""
