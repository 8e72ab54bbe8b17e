"""Unsigned 64-bit arithmetic, for Python integers, numpy arrays and Spark columns alike.

A generator's output function is written against an ``Ops`` object.  ``IntOps`` evaluates it exactly on the driver,
``ArrayOps`` a block at a time; ``ColumnOps`` turns it into built-in expressions, naming intermediate values as columns of their own so that an
expression used twice is not copied.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1
SIGN = -(1 << 63)


def signed(x: int) -> int:
    """The BIGINT with the same 64 bits."""
    x &= MASK64
    return x - (1 << 64) if x >> 63 else x


@contextmanager
def wrapping(spark: SparkSession) -> Iterator[None]:
    """Within it, built expressions wrap around like unsigned ones; the session's setting is restored in any case.

    Whether arithmetic raises on overflow is fixed when an expression is built, so the plan keeps wrapping afterwards.
    """
    key = "spark.sql.ansi.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class IntOps:
    """Unsigned arithmetic of Python integers, ``bits`` wide."""

    def __init__(self, bits: int = 64):
        self.bits, self.mask = bits, (1 << bits) - 1

    def const(self, x):
        return x & self.mask

    def let(self, x):
        return x

    def add(self, a, b):
        return (a + b) & self.mask

    def mul(self, a, b):
        return (a * b) & self.mask

    def xor(self, a, b):
        return a ^ b

    def shr(self, a, n):
        return a >> n

    def rotl(self, a, n):
        return ((a << n) | (a >> (self.bits - n))) & self.mask

    def mulhi(self, a, b):
        return (a * b) >> self.bits

    def less(self, a, b):
        return int(a < b)


class ArrayOps:
    """The same on numpy arrays of uint64."""

    def let(self, x):
        return x

    def const(self, x: int):
        return np.uint64(x & MASK64)

    def add(self, a, b):
        return a + b

    def mul(self, a, b):
        return a * b

    def xor(self, a, b):
        return a ^ b

    def shr(self, a, n):
        return a >> np.uint64(n)

    def rotl(self, a, n):
        return (a << np.uint64(n)) | (a >> np.uint64(64 - n))

    def mulhi(self, a, b):
        return multiply(a, b)[0]

    def less(self, a, b):
        return (a < b).astype(np.uint64)


def multiply(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(high, low) words of the 128-bit products, from four products of 32-bit limbs."""
    low, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    a0, a1, b0, b1 = a & low, a >> half, b & low, b >> half
    p00, p01, p10 = a0 * b0, a0 * b1, a1 * b0
    middle = (p00 >> half) + (p01 & low) + (p10 & low)
    return a1 * b1 + (p01 >> half) + (p10 >> half) + (middle >> half), a * b


class ColumnOps:
    """The same on BIGINT columns holding raw bits; ``df`` grows by one column for each ``let``."""

    def __init__(self, df: DataFrame, prefix: str = "_v"):
        self.df, self.prefix, self.count = df, prefix, 0

    def let(self, x: Column) -> Column:
        name = f"{self.prefix}{self.count}"
        self.count += 1
        self.df = self.df.withColumn(name, x)
        return F.col(name)

    def const(self, x: int) -> Column:
        return F.lit(signed(x)).cast("long")

    def add(self, a, b):
        return a + b

    def mul(self, a, b):
        return a * b

    def xor(self, a, b):
        return a.bitwiseXOR(b)

    def shr(self, a, n):
        return F.shiftrightunsigned(a, n)

    def rotl(self, a, n):
        return F.shiftleft(a, n).bitwiseOR(F.shiftrightunsigned(a, 64 - n))

    def mulhi(self, a, b):
        """High half of the 128-bit product, from four products of 32-bit limbs."""
        low = F.lit(0xFFFFFFFF).cast("long")
        a0, a1 = self.let(a.bitwiseAND(low)), self.let(F.shiftrightunsigned(a, 32))
        b0, b1 = self.let(b.bitwiseAND(low)), self.let(F.shiftrightunsigned(b, 32))
        p01, p10 = self.let(a0 * b1), self.let(a1 * b0)
        middle = F.shiftrightunsigned(a0 * b0, 32) + p01.bitwiseAND(low) + p10.bitwiseAND(low)
        return a1 * b1 + F.shiftrightunsigned(p01, 32) + F.shiftrightunsigned(p10, 32) + F.shiftrightunsigned(middle, 32)

    def less(self, a, b):
        return (biased(a) < biased(b)).cast("long")


def biased(x: Column) -> Column:
    """Orders like the unsigned value of the raw bits."""
    return x.bitwiseXOR(F.lit(SIGN).cast("long"))
