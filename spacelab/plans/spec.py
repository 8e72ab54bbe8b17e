"""What a test is: its grid, its run, and which combinations are allowed."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from ..functions.stats import test_mean


class SpecError(ValueError):
    """An argument or a combination of arguments that no test has."""


def parse_u64(text: str) -> int:
    """Unsigned 64-bit integer in decimal or with 0x, 0o or 0b; underscores may separate digits."""
    found = re.fullmatch(r"(0[xX]|0[oO]|0[bB])?(.*)", text.strip(), re.S)
    base = {None: 10, "0x": 16, "0o": 8, "0b": 2}[found[1] and found[1].lower()]
    digits = found[2].replace("_", "")
    kinds = {2: "01", 8: "0-7", 10: "0-9", 16: "0-9a-fA-F"}
    if not re.fullmatch(rf"\+?[{kinds[base]}]+", digits) or int(digits, base) >> 64:
        raise SpecError(f"invalid integer: {text!r}")
    return int(digits, base)


@dataclass(frozen=True)
class Grid:
    """t coordinates of the u bits that lie below the top s of a draw; d low bits of each are decimated."""

    u: int
    t: int
    s: int = 0
    d: int = 0

    def __post_init__(self):
        if self.t < 1:
            raise SpecError("a sample needs one draw or more: t >= 1")
        if self.u < 1:
            raise SpecError("a draw gives one bit or more: u >= 1")
        if not 0 <= self.s < 64:
            raise SpecError(f"a shift lies between 0 and 63, not {self.s}")
        if self.u > 64 - self.s:
            raise SpecError(f"u = {self.u} bits do not fit below a shift of {self.s}: {64 - self.s} at most")
        if not 0 <= self.d < self.u:
            raise SpecError(f"d = {self.d} leaves no bits of u = {self.u}")
        if self.width > 128:
            raise SpecError("cell indices have 128 bits at most")

    @property
    def width(self) -> int:
        """Bits of a cell index."""
        return self.t * (self.u - self.d)

    @property
    def cells(self) -> int:
        return 1 << self.width

    @property
    def storage(self) -> int:
        """Bits of the smallest word that holds an index."""
        return 32 if self.width <= 32 else 64 if self.width <= 64 else 128

    def samples(self, points: int) -> int:
        """Samples to scan so that ``points`` are kept on average."""
        found = points << (self.t * self.d)
        if found >> 63:
            raise SpecError("too many samples to scan: points * 2^(t d) reaches 2^63")
        return found


@dataclass(frozen=True)
class Run:
    """A test run.  ``m``: points kept in one of the 2^b units, the most that the test allows if None."""

    grid: Grid
    generator: str = "splitmix"
    m: int | None = None
    b: int = 0
    birthday: bool = False
    checkpoints: bool = False
    reps: int = 1
    seed: int = 0
    only: int | None = None  # the one unit to run
    pretty: bool = False
    strict: bool = False  # a bin above its headroom is an error
    replay: bool = False  # scan the orbit anew for each unit, so that only one unit lies on disk

    def __post_init__(self):
        g = self.grid
        if g.d and self.m is None:
            raise SpecError("with decimation, m has to be given")
        if self.b < 0 or self.b > g.width:
            raise SpecError(f"b = {self.b} is not within the {g.width} bits of a cell index")
        if self.b >= 64:
            raise SpecError(f"b = {self.b} asks for 2^64 passes or more")
        if self.checkpoints and self.birthday:
            raise SpecError("birthday-spacings tests have no checkpoints")
        if self.checkpoints and (self.b or not g.d):
            raise SpecError("checkpoints need decimation (d) and exclude passes (b)")
        if self.only is not None and not (self.b and 0 <= self.only < 1 << self.b):
            raise SpecError("a single unit needs b and a number below 2^b")
        if self.reps < 1:
            raise SpecError("one repetition or more")
        if self.m is not None and self.m < 1:
            raise SpecError("m is one point or more")

    @property
    def points(self) -> int:
        """Nominal points: m * 2^b."""
        m = self.m
        if m is None:
            m = (most_birthday_points(self.grid, self.reps) if self.birthday else min(self.grid.cells, (1 << 64) - 1)) >> self.b
        return m << self.b

    @property
    def samples(self) -> int:
        return self.grid.samples(self.points)

    @property
    def mean(self) -> float:
        """Poisson mean of one repetition, of the nominal points."""
        return test_mean(self.points, self.grid.cells, self.birthday)

    def check_size(self) -> None:
        """The bounds that the command line enforces; the library also runs small tests."""
        if self.birthday:
            if self.points > most_birthday_points(self.grid, self.reps):
                raise SpecError(f"{self.points} points are too many for these cells and repetitions: {most_birthday_points(self.grid, self.reps)} at most, which is the default")
        elif self.points > self.grid.cells:
            raise SpecError(f"{self.points} points in only {self.grid.cells} cells")
        if self.points < 10_000:
            raise SpecError(f"{self.points} points are too few: 10000 at least")

    def stages(self) -> list[int]:
        """Samples scanned at the end of each checkpoint: floor(sqrt(2^(t d))) equal stages."""
        power = self.grid.t * self.grid.d
        count = max(1, min(math.isqrt(1 << power), self.samples))
        return [self.samples * k // count for k in range(1, count + 1)]


def most_birthday_points(grid: Grid, reps: int) -> int:
    """The points that make a birthday-spacings test most powerful while its Poisson mean is a good one."""
    return int(float(grid.cells) ** (5 / 12) / (2.0 * reps) ** (1 / 3))
