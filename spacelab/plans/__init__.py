"""Specifications of tests, and the plans that run and report them."""
