"""Scalar functions: unsigned bit arithmetic on columns, and the statistics of the tests."""
