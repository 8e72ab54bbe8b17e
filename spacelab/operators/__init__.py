"""Relational operators of the tests, over DataFrames of points."""
