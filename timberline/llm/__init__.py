"""Operators for preparing training text: one module for each, queries in :mod:`.queries`.

Nothing else in the library imports this subpackage.
"""
