"""Operators for preparing training data at scale.

Each module is one operator over DataFrames; ``queries`` holds the thin queries over the
standard tables.  Nothing else in the package imports this subpackage.
"""
