"""Collision counts: points minus distinct cells, whole, by value interval, and by checkpoint of the scan.

Duplicates are counted by hash aggregation.  Cells are counted once before the shuffle, so repeated cells travel once a
task; nothing is sorted and no task sees more than its share of the distinct cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cells import CellCodec
from .prefix import running_sums


def pass_counts(points: DataFrame, codec: CellCodec, b: int = 0, only: int | None = None) -> DataFrame:
    """(rep, pass, points, collisions) for each repetition and each of the 2^b value intervals that has points."""
    if only is not None:
        points = points.where(codec.top(b) == only)
    cells = points.groupBy("rep", *codec.columns).agg(F.count("*").alias("n"))
    return (
        cells.select("rep", codec.top(b).alias("pass"), "n").groupBy("rep", "pass")
        .agg(F.sum("n").alias("points"), F.sum(F.col("n") - 1).alias("collisions"))
    )


def histogram(points: DataFrame, codec: CellCodec, b: int) -> DataFrame:
    """(rep, pass, points): how many points fall in each value interval."""
    return points.groupBy("rep", codec.top(b).alias("pass")).agg(F.count("*").alias("points"))


def checkpoint_counts(points: DataFrame, codec: CellCodec, samples: int, stages: int) -> DataFrame:
    """(rep, stage, points, collisions), each cumulative up to the stage's end at floor(samples * stage / stages).

    A point collides in the first stage by which its cell is no longer new, so the collisions of a stage are its points
    less the cells that first occur in it.  Stage of sample j: the least k with j < floor(samples * k / stages).  Stages
    may be many: their sums run in blocks.
    """
    marked = points.select("rep", *codec.columns, _stage(samples, stages).alias("stage"))
    seen = marked.groupBy("rep", "stage").agg(F.count("*").alias("here"))
    fresh = marked.groupBy("rep", *codec.columns).agg(F.min("stage").alias("stage")).groupBy("rep", "stage").agg(F.count("*").alias("new"))
    none = F.lit(0).cast("long")
    found = seen.select("rep", "stage", "here", none.alias("new")).unionByName(fresh.select("rep", "stage", none.alias("here"), "new"))
    found = found.unionByName(_numbers(seen.select("rep").distinct(), stages).select("rep", "stage", none.alias("here"), none.alias("new")))
    each = found.groupBy("rep", "stage").agg(F.sum("here").alias("here"), F.sum(F.col("here") - F.col("new")).alias("again"))
    return running_sums(each, ["rep"], "stage", {"points": "here", "collisions": "again"}, top=stages.bit_length()).select("rep", "stage", "points", "collisions")


def _numbers(reps: DataFrame, count: int, block: int = 1 << 16) -> DataFrame:
    """(rep, stage) for stages 1 .. count, made in blocks so that no task makes all."""
    blocks = reps.select("rep", F.explode(F.sequence(F.lit(0), F.lit((count - 1) // block))).alias("block"))
    if count > block:
        blocks = blocks.repartition("rep", "block")
    first = F.col("block").cast("long") * block
    return blocks.select("rep", F.explode(F.sequence(first + 1, F.least(first + block, F.lit(count).cast("long")))).alias("stage"))


def _stage(samples: int, stages: int) -> Column:
    """j < floor(samples k / stages) holds from k = (j + 1) stages / samples on, rounded up."""
    kind = "bigint" if samples * (stages + 1) < 1 << 62 else "decimal(38,0)"
    return F.expr(f"CAST(((CAST(pmod(sample_id, {samples}L) AS {kind}) + 1) * {stages} + {samples - 1}) DIV {samples}L AS BIGINT)")
