"""Operators that prepare training corpora: dedup, scoring, filtering, mixing, sharding.

Nothing else in the library imports this subpackage.
"""
