"""Running collision counts over a stream of draws: Structured Streaming with the batch operators' arithmetic.

Cells are counted in the state store, one row a distinct cell, and the small table of counts by interval is kept up to
date for each micro-batch.  A restarted query goes on from its checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.cells import CellCodec, points
from ..plans.spec import Grid


def cell_counts(draws: DataFrame, grid: Grid) -> DataFrame:
    """A streaming DataFrame of draws -> the count of every cell seen so far (update or complete mode)."""
    return points(draws, grid).groupBy(*CellCodec(grid.width).columns).agg(F.count("*").alias("n"))


def progress_writer(draws: DataFrame, grid: Grid, path: str, b: int = 0) -> DataStreamWriter:
    """Writes (batch, pass, points, collisions) so far below ``path``, one folder a micro-batch; start() it.

    In complete mode a batch holds all counts, so each folder is a whole result; a repeated batch overwrites its own.
    """
    codec = CellCodec(grid.width)

    def sink(counts: DataFrame, batch: int) -> None:
        (
            counts.groupBy(codec.top(b).alias("pass")).agg(F.sum("n").alias("points"), F.sum(F.col("n") - 1).alias("collisions"))
            .withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/batch-{batch}")
        )

    return cell_counts(draws, grid).writeStream.outputMode("complete").foreachBatch(sink)


def running_passes(draws: DataFrame, grid: Grid, b: int = 0) -> DataFrame:
    """A streaming DataFrame of draws -> (pass, points, collisions) of everything so far.

    In update mode a micro-batch sends only the passes that it changed.  The state holds each distinct cell once, as the
    key of ``dropDuplicates``, and a row a pass; nothing leaves the state store but new cells and changed passes.
    """
    codec = CellCodec(grid.width)
    kept = points(draws, grid).select(*codec.columns, codec.top(b).alias("pass"))
    every = kept.select("pass", F.lit(1).cast("long").alias("n"))
    first = kept.dropDuplicates(codec.columns).select("pass", F.lit(0).cast("long").alias("n"))
    return every.unionByName(first).groupBy("pass").agg(
        F.sum("n").alias("points"), F.sum(2 * F.col("n") - 1).alias("collisions"))


def change_writer(draws: DataFrame, grid: Grid, path: str, b: int = 0) -> DataStreamWriter:
    """Writes the passes that each micro-batch changed below ``path``, as a partition of the batch's number; start() it.

    A batch that is run again after a failure replaces its own partition.
    """

    def sink(changes: DataFrame, batch: int) -> None:
        (
            changes.withColumn("batch", F.lit(batch).cast("long")).coalesce(1)  # 2^b rows at most
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
        )

    return running_passes(draws, grid, b).writeStream.outputMode("update").foreachBatch(sink)


def latest(changes: DataFrame) -> DataFrame:
    """(pass, points, collisions) as of each pass's last change."""
    return changes.groupBy("pass").agg(F.max_by(F.struct("points", "collisions"), "batch").alias("at")).select("pass", "at.points", "at.collisions")
