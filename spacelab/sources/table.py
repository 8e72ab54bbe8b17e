"""Any table as a source of draws: its integral columns are the coordinates of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bits import ColumnOps, wrapping
from .generators import generator
from .orbit import draw_names


def table_draws(df: DataFrame, columns: list[str], order: str | None = None, mixed: bool = False) -> DataFrame:
    """sample_id and one draw for each of ``columns``.

    A value is taken as its 64 bits; a grid with s = 64 - u reads its lowest u bits.  ``mixed`` passes values through
    SplitMix's output function first, so that keys without structure are expected to look uniform.  ``order`` is the
    integral column that numbers samples (needed for checkpoints only); without it sample_id is 0.  Rows with a null in
    any of the columns are no samples.
    """
    names = draw_names(len(columns))
    kept = df.select(
        (F.col(order).cast("long") if order else F.lit(0).cast("long")).alias("sample_id"),
        *(F.col(c).cast("long").alias(n) for c, n in zip(columns, names))).dropna()
    if not mixed:
        return kept
    with wrapping(df.sparkSession):
        ops = ColumnOps(kept)
        outputs = [ops.let(_mix(ops, F.col(n))) for n in names]
        return ops.df.select("sample_id", *(o.alias(n) for o, n in zip(outputs, names)))


def _mix(ops: ColumnOps, value):
    """SplitMix's output for the state that ``value`` numbers."""
    return generator("splitmix").column(ops, 0, value)
