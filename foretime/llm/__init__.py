"""Operators of a training-data pipeline over `documents`-shaped tables.

Nothing outside this subpackage imports it.
"""
