"""Operators of a training-data pipeline over web-scale text tables.

Nothing else in the library imports this subpackage.
"""
