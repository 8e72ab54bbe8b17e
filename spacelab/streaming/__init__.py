"""Counts over streams of points."""
