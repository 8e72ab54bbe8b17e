"""Value-interval predicates that reach the scan, and cell tables kept by pass.

A pass asks for the cells whose top bits have one value.  Those bits come from the first coordinate, so the predicate
says something about one raw column.  Where that is a range, the range is added as a plain comparison, which Catalyst
pushes into the Parquet scan; the exact predicate on the cell stays, so results never depend on it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import signed
from ..plans.spec import Grid, SpecError
from ..sources.storage import delete_at_exit, shared_folder
from .cells import CellCodec


def pass_range(column: str, grid: Grid, b: int, only: int) -> Column | None:
    """What the raw values of the first coordinate's column satisfy in pass ``only`` of 2^b; None if that is no range.

    Coordinates of the lowest u bits (s = 64 - u) have a range below 2^u; larger and negative values may always belong
    to the pass.  Coordinates of the top u bits (s = 0) have a range of signed values.
    """
    if not 0 <= only < 1 << b:
        raise SpecError(f"pass {only} is none of 2^{b}")
    told = min(b, grid.u - grid.d)  # bits of the pass that the first coordinate has
    if not told:
        return None
    key, rest = only >> (b - told), grid.u - told
    low, high = key << rest, ((key + 1) << rest) - 1
    value = F.col(column)
    if grid.s + grid.u == 64 and grid.u < 63:
        return ((value >= low) & (value <= high)) | (value < 0) | (value >= 1 << grid.u)
    if grid.s == 0:
        shift = 64 - grid.u
        return (value >= F.lit(signed(low << shift)).cast("long")) & (value <= F.lit(signed((high << shift) | ((1 << shift) - 1))).cast("long"))
    return None


def in_pass(df: DataFrame, column: str, grid: Grid, b: int, only: int) -> DataFrame:
    """Rows of a table that may have a point in the pass; the raw column is compared as it is stored."""
    found = pass_range(column, grid, b, only)
    return df if found is None else df.where(found)


def by_pass(points: DataFrame, codec: CellCodec, b: int, path: str | None = None) -> DataFrame:
    """``points`` written once, in a folder for each pass, and read back with a column pass; replaying a pass reads its folder only.

    2^b folders, so b is at most 12.  ``path``: below the shared folder if None, and gone with the application.
    """
    if b > 12:
        raise SpecError("more than 2^12 folders; count more passes in one go")
    spark = points.sparkSession
    place = path or f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    if path is None:
        delete_at_exit(spark, place)
    points.withColumn("pass", codec.top(b)).write.mode("overwrite").partitionBy("pass").parquet(place)
    fields = ", ".join(f"{c} {t}" for c, t in points.dtypes)
    return spark.read.schema(f"{fields}, pass long").parquet(place)
