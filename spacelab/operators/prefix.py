"""Sums so far over a long numbered sequence, and gapless ranks, without a window over all rows.

A window that is ordered but not partitioned is one task.  Here the sequence is cut into blocks of consecutive numbers
or key ranges, sums run inside each block, the blocks' totals are summed in turn, and each row adds what lies below its
block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import stored

BLOCK_BITS = 12
MOST_PARTS = 1 << 17  # parts whose offsets are broadcast


def running_sums(df: DataFrame, by: list[str], at: str, values: dict[str, str], bits: int = BLOCK_BITS, top: int = 63) -> DataFrame:
    """``df`` with a column for each of ``values`` (name -> column): its sum over the rows of equal ``by`` up to ``at``.

    ``at`` is a non-negative BIGINT below 2^top.  No task sees more than 2^bits numbers, and the table of block totals
    is summed in the same way.  Rows of equal ``at`` get the same sums; null values add nothing.
    """
    so_far = Window.partitionBy(*by, "_block").orderBy(at).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.withColumn("_block", F.shiftright(at, bits))
    inside = rows.select("*", *(F.coalesce(F.sum(c).over(so_far), F.lit(0)).alias(f"_in_{n}") for n, c in values.items()))
    totals = rows.groupBy(*by, "_block").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(f"_of_{n}") for n, c in values.items()))
    names = {f"_to_{n}": f"_of_{n}" for n in values}
    if top - bits > bits:
        totals = running_sums(totals.withColumnRenamed("_block", "_at"), by, "_at", names, bits, top - bits).withColumnRenamed("_at", "_block")
    else:
        blocks = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        totals = totals.select("*", *(F.sum(c).over(blocks).alias(n) for n, c in names.items()))
    below = totals.select(*by, "_block", *(((F.col(f"_to_{n}") - F.col(f"_of_{n}")).alias(f"_below_{n}")) for n in values))
    return inside.join(below, [*by, "_block"]).select(*df.columns, *((F.col(f"_below_{n}") + F.col(f"_in_{n}")).alias(n) for n in values))


def gapless_rank(df: DataFrame, order: list[str | Column], name: str = "rank") -> tuple[DataFrame, int]:
    """``df`` with a column ``name`` that numbers its rows from 0 in the order of ``order``, and how many there are.

    Rows are dealt by ranges of the order, numbered inside each range, and moved up by the rows of the ranges below.  Rows
    that are equal in ``order`` are numbered in some order; equal ones may be as many as all rows, since their place in
    the table tells them apart when ranges are cut.  Nulls come first.
    """
    taken = {c.lower() for c in df.columns}
    free = lambda c: c if c not in taken else free(c + "_")
    tie, at = free("_tie"), free("_at")
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = df.withColumn(tie, F.monotonically_increasing_id())
    ranged = rows.repartitionByRange(*keys, F.col(tie)).sortWithinPartitions(*keys, F.col(tie))
    # the number that Spark gives a row is its partition, shifted by 33, and its place in the partition
    placed = stored(ranged.drop(tie).withColumn(at, F.monotonically_increasing_id()))
    part = F.shiftright(at, 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    below = counts.select("part", "n", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("below"))  # a row a partition
    offsets = stored(below)
    last = offsets.orderBy(F.col("part").desc()).first()
    parts = F.broadcast(offsets) if last is None or last["part"] < MOST_PARTS else offsets
    ranked = placed.join(parts.select("part", "below"), part == F.col("part"))
    place = F.col(at).bitwiseAND((1 << 33) - 1)
    return ranked.select(*df.columns, (F.col("below") + place).alias(name)), (last["below"] + last["n"] if last else 0)
