"""Circular spacings of sorted points, and counts of equal spacings, whole and by class.

Equal points are counted before anything is sorted: a cell of n points gives n - 1 spacings of zero and one to the cell
before it, so a cell that holds a third of all points is one row.  The distinct cells are dealt into value intervals
whose borders come from the data (Spark's range partitioning takes them from a sample of the cells), so intervals have
about equal loads whatever the values are.  Inside an interval the sorted cells are subtracted from their successors as
they stream by; an interval's first cell takes the last of the nearest interval below, from a table of one row an
interval.  The spacing from the last point around to the first is one more row a repetition.  If all points of a
repetition are equal there is no such row; the count is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bits import wrapping
from ..sources.storage import stored
from .cells import CellCodec

SPACING = "spacing"
ROWS, BORDER = 0, 1


def interval_bits(codec: CellCodec, points: int, target: int = 1 << 20) -> int:
    """Bits that number intervals of about ``target`` points, 16 at most; they do not change results."""
    return min(codec.width, 16, (max(points, 1) // target).bit_length())


def _words(batch: pa.RecordBatch, columns: list[str]) -> list[np.ndarray]:
    return [batch.column(c).to_numpy().view(np.uint64) for c in columns]


def _minus(later: list[np.ndarray], earlier: list[np.ndarray], width: int) -> list[np.ndarray]:
    """later - earlier modulo 2^width, word by word."""
    mask = lambda bits: np.uint64((1 << bits) - 1)
    low = later[-1] - earlier[-1]
    if len(later) == 1:
        return [low & mask(width)]
    high = later[0] - earlier[0] - (later[1] < earlier[1]).astype(np.uint64)
    return [high & mask(width - 64), low]


def in_intervals(points: DataFrame, codec: CellCodec, bits: int | None = None, counted: bool = False) -> DataFrame:
    """Spacings inside value intervals, and a row for each interval and repetition.  ``counted``: rows are distinct cells with a column n.

    (kind, rep, spacing words, n, first words, last words): kind ``ROWS`` has a spacing and how often it occurs, kind
    ``BORDER`` an interval's first and last cell and in n its distinct cells.  ``bits``: 2^bits intervals at most; None:
    as many as adaptive execution makes of the session's shuffle partitions.
    """
    out = CellCodec(codec.width, SPACING).columns
    first, last = ([f"{e}_{i}" for i in range(len(codec.columns))] for e in ("first", "last"))
    kind_of_rep = points.schema["rep"].dataType  # any integral type
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("rep", T.LongType())] + [
        T.StructField(c, T.LongType()) for c in (*out, "n", *first, *last)])
    names, width = list(codec.columns), codec.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None  # the repetition that may go on: its number, first and last words, cells

        def batch_of(kind, rep, spacing, n, ends=None) -> pa.RecordBatch:
            size = len(n)
            blank = [None] * len(names)
            columns = [pa.array(np.full(size, kind, np.int32)), pa.array(np.full(size, rep, np.int64))]
            for words in (spacing, [n], *(ends or (blank, blank))):
                columns += [pa.nulls(size, pa.int64()) if w is None else pa.array(np.asarray(w).view(np.int64)) for w in words]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        def border() -> pa.RecordBatch:
            ends = [[w[:1] for w in held["first"]], [w[-1:] for w in held["last"]]]
            return batch_of(BORDER, held["rep"], [None] * len(names), np.array([held["n"]]), ends)

        for batch in batches:
            reps, words, copies = batch.column("rep").to_numpy(), _words(batch, names), batch.column("n").to_numpy()
            starts = np.flatnonzero(np.r_[True, reps[1:] != reps[:-1]]) if len(reps) else []
            for a, b in zip(starts, [*starts[1:], len(reps)]):
                own, rep = [w[a:b] for w in words], int(reps[a])
                if held and held["rep"] != rep:
                    yield border()
                    held = None
                before = own if held is None else [np.concatenate([e, w]) for e, w in zip(held["last"], own)]
                gaps = _minus([w[1:] for w in before], [w[:-1] for w in before], width)
                if len(gaps[0]):
                    yield batch_of(ROWS, rep, gaps, np.ones(len(gaps[0]), np.int64))
                again = int((copies[a:b] - 1).sum())
                if again:
                    yield batch_of(ROWS, rep, [np.zeros(1, np.uint64) for _ in names], np.array([again]))
                held = {"rep": rep, "first": held["first"] if held else [w[:1].copy() for w in own], "last": [w[-1:].copy() for w in own],
                        "n": (held["n"] if held else 0) + b - a}
        if held:
            yield border()

    # repeated cells travel once a task
    cells = points if counted else points.groupBy("rep", *names).agg(F.count("*").alias("n"))
    keys = [F.col("rep"), *codec.order()]
    ranged = cells.repartitionByRange(*keys) if bits is None else cells.repartitionByRange(1 << bits, *keys)
    found = ranged.sortWithinPartitions(*keys).select("rep", *names, "n").mapInArrow(run, schema)
    return found.withColumn("rep", F.col("rep").cast(kind_of_rep))


def spacings(points: DataFrame, codec: CellCodec, bits: int | None = None, counted: bool = False) -> DataFrame:
    """(rep, spacing words, n): the circular spacings, in rows of one or more equal ones; 2^bits intervals at most."""
    out = CellCodec(codec.width, SPACING)
    found = stored(in_intervals(points, codec, bits, counted))
    words = range(len(codec.columns))
    flip = lambda side: F.struct(*(F.col(f"{side}_{i}").bitwiseXOR(F.lit(-(1 << 63))) for i in words))
    raw = lambda side: F.struct(*(F.col(f"{side}_{i}").alias(f"w{i}") for i in words))
    borders = found.where(F.col("kind") == BORDER).select("rep", flip("first").alias("at"), raw("first").alias("lo"), raw("last").alias("hi"))
    before = Window.partitionBy("rep").orderBy("at")  # a row an interval
    carried = borders.withColumn("below", F.lag("hi").over(before)).where(F.col("below").isNotNull())
    ends = borders.groupBy("rep").agg(F.min_by("lo", "at").alias("lo"), F.max_by("hi", "at").alias("hi")).where("lo <> hi")
    with wrapping(points.sparkSession):
        minus = lambda a, b: codec.minus([F.col(f"{a}.w{i}") for i in words], [F.col(f"{b}.w{i}") for i in words])
        named = lambda df, a, b: df.select("rep", *(d.alias(n) for d, n in zip(minus(a, b), out.columns)), F.lit(1).cast("long").alias("n"))
        across, around = named(carried, "lo", "below"), named(ends, "lo", "hi")
    return found.where(F.col("kind") == ROWS).select("rep", *out.columns, "n").unionByName(across).unionByName(around)


def class_counts(found: DataFrame, width: int, b: int = 0, only: int | None = None) -> DataFrame:
    """(rep, klass, spacings, collisions): equal spacings by the low b bits of the spacing."""
    codec = CellCodec(width, SPACING)
    if only is not None:
        found = found.where(codec.low_bits(b) == only)
    each = found.groupBy("rep", *codec.columns).agg(F.sum("n").alias("n"))
    return (
        each.select("rep", codec.low_bits(b).alias("klass"), "n").groupBy("rep", "klass")
        .agg(F.sum("n").alias("spacings"), F.sum(F.col("n") - 1).alias("collisions"))
    )
