"""Draws of a generator's orbit as a DataFrame: sample_id and the t draws of each sample, as raw 64-bit patterns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bits import ColumnOps, signed, wrapping
from .generators import Generator, generator
from .storage import stored

LANE = 1024  # samples of a lane
LANES = 2048  # lanes stepped together
PER_TASK = 1 << 24  # samples of a task at most
BLOCK = 1 << 18  # samples made at once


def draw_names(t: int) -> list[str]:
    return [f"draw_{i}" for i in range(t)]


def _tasks(spark: SparkSession, samples: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-samples // PER_TASK))


def orbit(spark: SparkSession, name: str, seed: int, samples: int, t: int, first: int = 0) -> DataFrame:
    """Samples first .. first + samples - 1 of the orbit; sample j is the draws j t .. j t + t - 1."""
    g = generator(name)
    if (first + samples) * t >> 48:
        raise ValueError("draws beyond 2^48 are out of range")
    if g.column:
        return _closed_form(spark, g, seed, samples, t, first)
    return _in_lanes(spark, g, seed, samples, t, first)


def _closed_form(spark: SparkSession, g: Generator, seed: int, samples: int, t: int, first: int) -> DataFrame:
    """Only built-in expressions over ``range``: one generated-code span, no Python on the executors."""
    with wrapping(spark):
        ops = ColumnOps(spark.range(first, first + samples, 1, _tasks(spark, samples)).withColumnRenamed("id", "sample_id"))
        draws = [ops.let(g.column(ops, signed(seed), ops.let(F.col("sample_id") * t + i))) for i in range(t)]
        return ops.df.select("sample_id", *(d.alias(n) for d, n in zip(draws, draw_names(t))))


def segments(spark: SparkSession, g: Generator, seed: int, samples: int, t: int, first: int = 0) -> DataFrame:
    """(lane, words): the state at the start of every lane of ``LANE`` samples.

    Where the generator jumps, each task jumps to its own lanes; else one sequential task walks the orbit once and its
    table is stored, since the walk is the expensive part.
    """
    schema = T.StructType([T.StructField("lane", T.LongType()), T.StructField("words", T.ArrayType(T.LongType()))])
    lanes = -(-samples // LANE)

    def jumping(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column("id").to_pylist()
            words, state, at = [], None, None
            for n in numbers:
                state = g.jump(state, LANE * t) if at is not None and n == at + 1 else g.at(seed, (first + n * LANE) * t)
                at = n
                words.append([signed(w) for w in g.pack(state)])
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(words, pa.list_(pa.int64()))], names=["lane", "words"])

    def walking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                state, numbers, words = g.at(seed, first * t), [], []
                for n in range(lanes):
                    numbers.append(n)
                    words.append([signed(w) for w in g.pack(state)])
                    for _ in range(LANE * t):
                        state = g.step(state)[1]
                    if len(numbers) == 4096 or n == lanes - 1:
                        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(words, pa.list_(pa.int64()))], names=["lane", "words"])
                        numbers, words = [], []

    if g.jump:
        return spark.range(0, lanes, 1, min(max(lanes, 1), _tasks(spark, samples))).mapInArrow(jumping, schema)
    return stored(spark.range(0, 1, 1, 1).mapInArrow(walking, schema)).repartition(_tasks(spark, samples), "lane")


def lane_draws(g: Generator, batches: Iterator[pa.RecordBatch], samples: int, t: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``segments`` rows -> (sample numbers, draws of each sample), lanes stepped side by side."""
    for batch in batches:
        for a in range(0, batch.num_rows, LANES):
            part = batch.slice(a, LANES)
            states = np.array(part.column("words").to_pylist(), np.int64).view(np.uint64)
            out = np.empty((LANE, t, len(states)), np.uint64)
            for j in range(LANE):
                for i in range(t):
                    out[j, i] = g.lanes(states)
            sample = np.arange(LANE)[:, None] + part.column("lane").to_numpy()[None, :] * LANE
            inside = sample < samples
            yield sample[inside], out.transpose(0, 2, 1)[inside]


def _in_lanes(spark: SparkSession, g: Generator, seed: int, samples: int, t: int, first: int) -> DataFrame:
    """Lanes of the orbit as rows."""
    names = draw_names(t)
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("sample_id", *names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sample, draws in lane_draws(g, batches, samples, t):
            columns = [pa.array(sample + first), *(pa.array(np.ascontiguousarray(draws[:, i]).view(np.int64)) for i in range(t))]
            yield pa.RecordBatch.from_arrays(columns, names=["sample_id", *names])

    return segments(spark, g, seed, samples, t, first).mapInArrow(run, schema)


def map_orbit(spark: SparkSession, name: str, seed: int, samples: int, t: int, make, schema: str) -> DataFrame:
    """Feed the orbit to ``make`` without rows in between.

    make(iterator of (sample numbers, uint64 draws of each sample)) -> Arrow batches of ``schema``.
    """
    g = generator(name)
    if samples * t >> 48:
        raise ValueError("draws beyond 2^48 are out of range")
    if g.block is None:
        return segments(spark, g, seed, samples, t).mapInArrow(lambda batches: make(lane_draws(g, batches, samples, t)), schema)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for n in batch.column("id").to_pylist():
                count = min(BLOCK, samples - n * BLOCK)
                yield np.arange(n * BLOCK, n * BLOCK + count), g.block(seed, n * BLOCK * t, count * t).reshape(count, t)

    total = -(-samples // BLOCK)
    return spark.range(0, total, 1, min(max(total, 1), _tasks(spark, samples))).mapInArrow(lambda batches: make(blocks(batches)), schema)
