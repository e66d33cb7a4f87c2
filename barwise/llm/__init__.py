"""Operators for preparing training text: deduplication, filtering, formatting, encoding, sharding.

Nothing outside this subpackage imports it.
"""
