"""Cell indices: how draws become points, and how points of up to 128 bits are stored, ordered and subtracted.

Up to 64 bits an index is one BIGINT of raw bits, beyond that two (high, low).  Below 64 bits the value is non-negative
and orders by itself; at 64 and 128 bits the words are compared with their sign bit flipped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import biased, signed, wrapping
from ..plans.spec import Grid
from ..sources.orbit import draw_names


@dataclass(frozen=True)
class CellCodec:
    width: int
    name: str = "cell"

    @property
    def columns(self) -> list[str]:
        return [self.name] if self.width <= 64 else [f"{self.name}_hi", f"{self.name}_lo"]

    @property
    def low(self) -> Column:
        return F.col(self.columns[-1])

    def order(self) -> list[Column]:
        """Sort keys in unsigned order."""
        cols = [F.col(c) for c in self.columns]
        return cols if self.width < 64 else [biased(c) for c in cols]

    def top(self, bits: int) -> Column:
        """The upper ``bits`` (below 64) of the index."""
        if not bits:
            return F.lit(0).cast("long")
        rest = self.width - bits
        if self.width <= 64:
            return F.shiftrightunsigned(self.low, rest) if rest else self.low
        high = F.col(self.columns[0])
        if rest >= 64:
            return F.shiftrightunsigned(high, rest - 64) if rest > 64 else high
        return F.shiftleft(high, 64 - rest).bitwiseOR(F.shiftrightunsigned(self.low, rest))

    def low_bits(self, bits: int) -> Column:
        return self.low.bitwiseAND(F.lit((1 << bits) - 1).cast("long")) if bits else F.lit(0).cast("long")

    def minus(self, a: list[Column], b: list[Column]) -> list[Column]:
        """a - b modulo 2^width, word by word; build it under ``wrapping``."""
        low = a[-1] - b[-1]
        if self.width <= 64:
            return [low if self.width == 64 else low.bitwiseAND(F.lit((1 << self.width) - 1).cast("long"))]
        borrow = (biased(a[-1]) < biased(b[-1])).cast("long")
        high = a[0] - b[0] - borrow
        return [high if self.width == 128 else high.bitwiseAND(F.lit((1 << (self.width - 64)) - 1).cast("long")), low]


def points(draws: DataFrame, grid: Grid) -> DataFrame:
    """draws (with any other columns) -> the cells of the samples that decimation keeps.

    Coordinate i is the u bits of draw i below its top s; a sample stays if the low d bits of all coordinates are zero,
    and the rest of the coordinates, joined left to right, is the cell.
    """
    names, codec = draw_names(grid.t), CellCodec(grid.width)
    rest = 64 - grid.u - grid.s
    mask = F.lit(signed((1 << grid.u) - 1)).cast("long")
    taken = [F.shiftrightunsigned(n, rest).bitwiseAND(mask) if rest or grid.u < 64 else F.col(n) for n in names]
    with wrapping(draws.sparkSession):
        if grid.d:
            low = taken[0]
            for e in taken[1:]:
                low = low.bitwiseOR(e)
            draws = draws.where(low.bitwiseAND(F.lit((1 << grid.d) - 1).cast("long")) == 0)
        step, words = grid.u - grid.d, [None] * len(codec.columns)
        for i, e in enumerate(taken):
            e = F.shiftrightunsigned(e, grid.d) if grid.d else e
            at = (grid.t - 1 - i) * step
            for k, base in enumerate((64, 0) if len(words) == 2 else (0,)):
                if base <= at < base + 64:
                    part = F.shiftleft(e, at - base) if at > base else e
                elif at < base < at + step:
                    part = F.shiftrightunsigned(e, base - at)
                else:
                    continue
                words[k] = part if words[k] is None else words[k].bitwiseOR(part)
        zero = F.lit(0).cast("long")
        others = [c for c in draws.columns if c not in names]
        return draws.select(*others, *((w if w is not None else zero).alias(c) for w, c in zip(words, codec.columns)))
