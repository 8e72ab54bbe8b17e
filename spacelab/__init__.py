"""Collision and birthday-spacings tests of pseudorandom generators, and of any integral columns, on Spark."""
