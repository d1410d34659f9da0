"""Operators for preparing training text: dedup, counting, filtering, mixing.

Nothing else in the library imports this subpackage.
"""
