"""Operators of a training-data pipeline over whole document tables.

Nothing outside this subpackage imports it.
"""
