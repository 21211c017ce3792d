"""Operators for preparing training text at scale.

Nothing else in the library imports this subpackage.  Each operator is a plain
function from DataFrames to a DataFrame; ``queries`` holds the registered queries.
"""
