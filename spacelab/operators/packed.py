"""The counting operators for indices of up to 64 bits, on packed runs of words instead of rows.

A row of the shuffle is then a sorted run of thousands of indices as one binary value: eight bytes a point, without the
cost of a row each.  Points of an orbit are made where they are packed, a block at a time, so none of them is ever a
row.  Tasks sort what they have made or read in portions and collapse repeats into counts before the shuffle, so
a cell that holds a third of all points travels once a portion.  Runs are dealt by a mixed value, which is even for any
generator; only spacings need the natural order, and are dealt by value interval.  Every run says how many points it has and
which are its least and its largest, so loads and borders of intervals come from a few numbers a run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.bits import biased, wrapping
from ..plans.spec import Grid, Run
from ..sources.orbit import map_orbit
from .cells import CellCodec

PORTION = 1 << 22  # points that a task sorts at once
MOST_INTERVAL_BITS = 16
PART = 1 << 20  # points of a part, about
MOST_IN_INTERVAL = 1 << 23  # above, spacings go through the row-wise operator, which spills
_ODD = 0x9E3779B97F4A7C15
_MIX, _BACK = np.uint64(_ODD), np.uint64(pow(_ODD, -1, 1 << 64))
RUNS = "rep int, part int, n long, least long, most long, words binary, counts binary"


def part_bits(points: int) -> int:
    """Parts of about ``PART`` points, a few for each core of a small machine at least."""
    return max(4, min(18, (points // PART).bit_length()))


def _collapsed(words: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Distinct sorted words and how often each occurs; None: once each.  Sorts ``words`` in place if it can."""
    if counts is None:
        words.sort()
    else:
        order = np.argsort(words, kind="stable")
        words, counts = words[order], counts[order]
    first = np.empty(len(words), bool)
    first[:1] = True
    np.not_equal(words[1:], words[:-1], out=first[1:])
    if first.all():
        return words, counts
    at = np.flatnonzero(first)
    return words[at], np.diff(np.r_[at, len(words)]) if counts is None else np.add.reduceat(counts, at)


def _runs(rep: int, words: np.ndarray, counts: np.ndarray | None, bits: int, width: int = 64) -> pa.RecordBatch:
    """Rows of ``RUNS`` for sorted words, cut by their top bits."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(width - bits) if bits else np.zeros(0, np.uint64)
    cuts = np.r_[0, np.searchsorted(words, edges), len(words)].tolist()
    full = [i for i in range(len(cuts) - 1) if cuts[i] < cuts[i + 1]]
    first, last = (np.array([cuts[i + k] for i in full], np.int64) for k in (0, 1))
    flip = np.uint64(1 << 63 if width == 64 else 0)  # least and most are ordered as signed numbers
    if counts is None:
        sizes = last - first
    else:
        counts = counts.astype(np.int64)
        sizes = np.add.reduceat(counts, first) if len(full) else first
    return pa.RecordBatch.from_arrays([
        pa.array([rep] * len(full), pa.int32()), pa.array(full, pa.int32()), pa.array(sizes),
        pa.array((words[first] ^ flip).view(np.int64)), pa.array((words[last - 1] ^ flip).view(np.int64)),
        pa.array([words[cuts[i] : cuts[i + 1]].tobytes() for i in full], pa.binary()),
        pa.array([counts[cuts[i] : cuts[i + 1]].tobytes() if counts is not None else b"" for i in full], pa.binary()),
    ], names=["rep", "part", "n", "least", "most", "words", "counts"])


Words = Iterator[tuple[int, np.ndarray]]


def _packed(found: Words, bits: int, width: int, mixed: bool) -> Iterator[pa.RecordBatch]:
    """(rep, words) -> runs by mixed value, or by value interval of ``width`` bits."""
    held: dict[int, list[np.ndarray]] = {}
    total = 0

    def flush():
        for rep, arrays in sorted(held.items()):
            yield _runs(rep, *_collapsed(np.concatenate(arrays)), bits, 64 if mixed else width)
        held.clear()

    for rep, words in found:
        held.setdefault(rep, []).append(words * _MIX if mixed else words)
        total += len(words)
        if total >= PORTION:
            yield from flush()
            total = 0
    yield from flush()


def _by_rep(reps: np.ndarray, words: np.ndarray) -> Words:
    for rep in np.unique(reps).tolist() if len(reps) and reps.min() != reps.max() else reps[:1].tolist():
        yield rep, words[reps == rep] if reps.min() != reps.max() else words


def _row_words(batches: Iterator[pa.RecordBatch]) -> Words:
    """(rep, word) rows as arrays."""
    for batch in batches:
        yield from _by_rep(batch.column("rep").to_numpy(), batch.column("word").to_numpy().view(np.uint64).copy())


def cells_of(draws: np.ndarray, grid: Grid) -> tuple[np.ndarray, np.ndarray | None]:
    """``points`` on a matrix of draws: the cells of up to 64 bits, and which samples stay (None: all)."""
    rest, step = np.uint64(64 - grid.u - grid.s), np.uint64(grid.u - grid.d)
    mask, low = np.uint64((1 << grid.u) - 1), np.uint64((1 << grid.d) - 1)
    cell = seen = None
    for i in range(grid.t):
        e = (draws[:, i] >> rest) & mask
        seen = e if seen is None else seen | e
        e = e >> np.uint64(grid.d)
        cell = e if cell is None else (cell << step) | e
    return cell, (seen & low) == 0 if grid.d else None


@dataclass(frozen=True)
class Source:
    """Points of up to 64 bits that runs are made of: an orbit, or rows with ``rep`` and a cell column."""

    spark: SparkSession
    grid: Grid
    expected: int
    rows: DataFrame | None = None
    run: Run | None = None

    def runs(self, bits: int, mixed: bool, top: tuple[int, int] | None = None) -> DataFrame:
        """``top``: (b, K) keeps only points whose upper b bits are K."""
        width, grid = self.grid.width, self.grid

        def chosen(found: Words) -> Words:
            for rep, words in found:
                yield rep, words[(words >> np.uint64(width - top[0])) == np.uint64(top[1])] if top else words

        if self.run is None:
            words = self.rows.select("rep", F.col(CellCodec(width).columns[0]).alias("word"))
            return words.mapInArrow(lambda batches: _packed(chosen(_row_words(batches)), bits, width, mixed), RUNS)
        samples = self.run.samples

        def words(found):
            for sample, draws in found:
                cell, stays = cells_of(draws, grid)
                rep = (sample // samples + 1).astype(np.int32)
                yield from _by_rep(rep, cell) if stays is None else _by_rep(rep[stays], cell[stays])

        return map_orbit(self.spark, self.run.generator, self.run.seed, samples * self.run.reps, grid.t,
                         lambda found: _packed(chosen(words(found)), bits, width, mixed), RUNS)


def _gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray | None]:
    """All words of a part, distinct, with their counts."""
    blobs, counts = table.column("words").to_pylist(), table.column("counts").to_pylist()
    words = np.frombuffer(b"".join(blobs), np.uint64).copy()
    if not any(counts):
        return _collapsed(words)
    return _collapsed(words, np.concatenate([np.frombuffer(c, np.int64) if c else np.ones(len(w) // 8, np.int64) for w, c in zip(blobs, counts)]))


def _counter(unit: Callable[[np.ndarray], np.ndarray], many: bool):
    """A part's runs -> (rep, unit, points, collisions); ``many``: units are told apart at all."""

    def count(key, table):
        words, counts = _gathered(table)
        if not many:
            units, distinct = np.zeros(1, np.uint64), np.array([len(words)])
            points = distinct if counts is None else np.array([counts.sum()])
        else:
            units, of = unit(words * _BACK), None
            if len(units) and int(units.max()) < 1 << 16:
                of, units = units.astype(np.int64), np.arange(int(units.max()) + 1, dtype=np.uint64)
            else:
                units, of = np.unique(units, return_inverse=True)
            distinct = np.bincount(of, minlength=len(units))
            points = distinct if counts is None else np.round(np.bincount(of, counts, minlength=len(units))).astype(np.int64)
            some = distinct > 0
            units, distinct, points = units[some], distinct[some], points[some]
        rep = pa.array([key[0].as_py()] * len(units), pa.int32())
        return pa.table([rep, pa.array(units.view(np.int64)), pa.array(points.astype(np.int64)), pa.array((points - distinct).astype(np.int64))],
                        names=["rep", "unit", "points", "collisions"])

    return count


def _counted(runs: DataFrame, unit, many: bool) -> DataFrame:
    each = runs.groupBy("rep", "part").applyInArrow(_counter(unit, many), "rep int, unit long, points long, collisions long")
    return each.groupBy("rep", "unit").agg(F.sum("points").alias("points"), F.sum("collisions").alias("collisions"))


def packed_pass_counts(source: Source, b: int = 0, only: int | None = None) -> DataFrame:
    """``pass_counts`` on packed runs."""
    runs = source.runs(part_bits(source.expected), True, None if only is None else (b, only))
    shift = np.uint64(source.grid.width - b)
    return _counted(runs, lambda x: x >> shift if b else x, b > 0).withColumnRenamed("unit", "pass")


def packed_interval_bits(width: int, points: int, b: int) -> int:
    """Bits that cut points into intervals of about ``PART``, the 2^b first ones told apart as far as 16 bits go."""
    return min(width, MOST_INTERVAL_BITS, max((max(points, 1) // PART).bit_length(), b))


def interval_borders(runs: DataFrame) -> DataFrame:
    """(rep, part, least, most, n) of each value interval that has points; least and most as ordered BIGINTs."""
    return runs.groupBy("rep", "part").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("n").alias("n"))


def packed_class_counts(source: Source, runs: DataFrame, borders: DataFrame, b: int = 0, only: int | None = None) -> DataFrame:
    """(rep, klass, spacings, collisions) of the circular spacings, from runs by value interval and ``interval_borders``."""
    width, parts = source.grid.width, part_bits(source.expected)
    mask = np.uint64((1 << b) - 1)

    def chosen(words: np.ndarray, counts: np.ndarray | None):
        if only is None:
            return words, counts
        inside = (words & mask) == np.uint64(only)
        return words[inside], counts[inside] if counts is not None else None

    def inner(key, table):
        """Spacings within an interval, packed by mixed value; repeated points give spacings of zero."""
        words, counts = _gathered(table)
        gaps, times = _collapsed(np.diff(words))
        zeros = int(counts.sum()) - len(words) if counts is not None else 0
        if zeros:
            times = np.r_[zeros, times if times is not None else np.ones(len(gaps), np.int64)]
            gaps = np.r_[np.uint64(0), gaps]
        gaps, times = chosen(gaps, times)
        gaps = gaps * _MIX
        order = np.argsort(gaps)
        return pa.Table.from_batches([_runs(key[0].as_py(), gaps[order], times[order] if times is not None else None, parts)])

    within = runs.groupBy("rep", "part").applyInArrow(inner, RUNS)
    below = Window.partitionBy("rep").orderBy("part")
    flip = (lambda c: c) if width < 64 else biased
    full = F.lit((1 << width) - 1).cast("long") if width < 64 else F.lit(-1).cast("long")
    with wrapping(source.spark):
        joints = borders.withColumn("prev", F.lag("most").over(below)).where("prev is not null").select(
            "rep", (flip(F.col("least")) - flip(F.col("prev"))).bitwiseAND(full).alias("word"))
        ends = borders.groupBy("rep").agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least <> most").select(
            "rep", (flip(F.col("least")) - flip(F.col("most"))).bitwiseAND(full).alias("word"))
    between = joints.union(ends)
    if only is not None:
        between = between.where(F.col("word").bitwiseAND(F.lit((1 << b) - 1).cast("long")) == only)
    packed = within.union(between.mapInArrow(lambda batches: _packed(_row_words(batches), parts, 64, True), RUNS))
    found = _counted(packed, lambda x: x & mask, b > 0)
    return found.withColumnsRenamed({"unit": "klass", "points": "spacings"})
