"""Tests on tables as DataFrames: ordered samples, repetitions, reports of many units, loads, and shares of a run.

Everything that ``runner`` does for an orbit on the driver is a plan here: means, p-values and sums so far are columns,
so a report may have any number of units.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import birthday_mean_of, expected_collisions_of, headroom_of, p_value_of
from ..operators.cells import CellCodec, points
from ..operators.collisions import checkpoint_counts, pass_counts
from ..operators.prefix import gapless_rank, running_sums
from ..operators.pruning import in_pass
from ..operators.spacings import SPACING, class_counts, spacings
from ..sources.storage import stored
from ..sources.table import table_draws
from .spec import Grid, SpecError


def ordered_draws(df: DataFrame, columns: list[str], order: list[str | tuple[str, bool]], mixed: bool = False) -> tuple[DataFrame, int]:
    """Draws of a table whose samples are numbered from 0 in the order of any columns, and how many samples there are.

    ``order`` has columns, or pairs of a column and whether it ascends, and ends with columns that break ties; samples
    that are equal in all of it are numbered in some order.  Rows with a null in one of ``columns`` are no samples.
    """
    keys = [(c, True) if isinstance(c, str) else c for c in order]
    rows = df.dropna(subset=columns).select(
        *(F.col(c).alias(f"_c_{i}") for i, c in enumerate(columns)), *(F.col(c).alias(f"_by_{i}") for i, (c, _) in enumerate(keys)))
    sort = [F.col(f"_by_{i}") if up else F.col(f"_by_{i}").desc() for i, (_, up) in enumerate(keys)]
    ranked, count = gapless_rank(rows, sort, "sample")
    return table_draws(ranked, [f"_c_{i}" for i in range(len(columns))], "sample", mixed), count


def in_repetitions(kept: DataFrame, samples: int, reps: int) -> DataFrame:
    """``kept`` with rep 1 .. reps: contiguous segments of the samples, the first ones longer by one where it does not come out even."""
    base, more = divmod(samples, reps)
    longer = more * (base + 1)
    j = F.col("sample_id")
    rest = F.lit(more) + F.floor((j - longer) / max(base, 1))
    return kept.withColumn("rep", (F.when(j < longer, F.floor(j / (base + 1))).otherwise(rest) + 1).cast("int"))


def with_p(df: DataFrame, count: str = "collisions", mean: str = "mean", prefix: str = "") -> DataFrame:
    """``df`` with the p-value of a count and, near 1, its distance to 1."""
    p = p_value_of(count, mean)
    return df.withColumn("_p", p).select(*df.columns, F.col("_p.value").alias(f"{prefix}p_value"), F.col("_p.eps").alias(f"{prefix}p_eps"))


def pass_report(kept: DataFrame, codec: CellCodec, b: int) -> DataFrame:
    """(rep, pass, points, collisions, mean, cum_points, cum_collisions, cum_mean, p_value, p_eps, cum_p_value, cum_p_eps) of the passes that have points."""
    part = 2.0 ** (codec.width - b)
    found = running_sums(pass_counts(kept, codec, b), ["rep"], "pass", {"cum_points": "points", "cum_collisions": "collisions"}, top=max(b, 1))
    found = found.withColumn("mean", expected_collisions_of("points", part)).withColumn(
        "cum_mean", expected_collisions_of("cum_points", (F.col("pass") + 1).cast("double") * part))
    return with_p(with_p(found), "cum_collisions", "cum_mean", "cum_")


def counted_cells(kept: DataFrame, codec: CellCodec) -> DataFrame:
    """(rep, cell words, n): distinct cells with their points, stored."""
    return stored(kept.groupBy("rep", *codec.columns).agg(F.count("*").alias("n")))


def class_report(counted: DataFrame, found: DataFrame, codec: CellCodec, b: int) -> DataFrame:
    """(rep, klass, spacings, collisions, mean, p_value, p_eps) from ``counted_cells`` and their ``spacings``.

    A class's mean is its share of that of the points kept.
    """
    loads = counted.groupBy("rep").agg(F.sum("n").alias("points"))
    each = class_counts(found, codec.width, b).join(loads, "rep")
    return with_p(each.withColumn("mean", birthday_mean_of("points", 2.0**codec.width) / 2.0**b).drop("points"))


def repetition_counts(counted: DataFrame, codec: CellCodec, found: DataFrame | None = None) -> DataFrame:
    """(rep, points, collisions, mean) from ``counted_cells``; with their ``spacings``, of the birthday-spacings test."""
    loads = counted.groupBy("rep").agg(F.sum("n").alias("points"), F.sum(F.col("n") - 1).alias("collisions"))
    cells = 2.0**codec.width
    if found is None:
        return loads.withColumn("mean", expected_collisions_of("points", cells))
    equal = class_counts(found, codec.width).select("rep", "collisions")
    every = loads.drop("collisions").join(equal, "rep", "left").select("rep", "points", F.coalesce("collisions", F.lit(0)).alias("collisions"))
    return every.withColumn("mean", birthday_mean_of("points", cells))


def repetition_report(kept: DataFrame, codec: CellCodec, birthday: bool = False) -> DataFrame:
    """(rep, points, collisions, mean, cum_points, cum_collisions, cum_mean, p_value, p_eps, cum_p_value, cum_p_eps).

    A repetition's mean depends on the points that it kept; means and counts of all up to it add up.
    """
    counted = counted_cells(kept, codec)
    found = repetition_counts(counted, codec, spacings(counted, codec, counted=True) if birthday else None)
    at = found.withColumn("_at", F.col("rep").cast("long"))
    summed = running_sums(at, [], "_at", {"cum_points": "points", "cum_collisions": "collisions", "cum_mean": "mean"}, top=31).drop("_at")
    return with_p(with_p(summed), "cum_collisions", "cum_mean", "cum_")


def checkpoint_report(kept: DataFrame, codec: CellCodec, samples: int, stages: int) -> DataFrame:
    """(rep, stage, points, collisions, mean, p_value, p_eps), each for all samples up to the stage's end."""
    found = checkpoint_counts(kept, codec, samples, stages).withColumn("mean", expected_collisions_of("points", 2.0**codec.width))
    return with_p(found)


# ----- loads -----


def seen_by(observation: Observation, name: str) -> int:
    """An observed count; 0 where the plan of an empty table has nothing left to observe."""
    try:
        return observation.get[name] or 0
    except Py4JJavaError:
        return 0


def load_report(draws: DataFrame, grid: Grid, b: int) -> DataFrame:
    """(kind, unit, load, cap, alarm): the loads of 2^b passes, value intervals and spacing classes against their headroom.

    The draws are scanned once: the scan that counts cells also observes how many samples there are, which the caps
    depend on.  A load above its cap has probability below 10^-1000 under a uniform generator.  Passes and intervals
    are both the top b bits; an interval's load are its points, a pass's cap is that of the cells counted in it.
    """
    codec, seen = CellCodec(grid.width), Observation()
    kept = points(draws.observe(seen, F.count(F.lit(1)).alias("samples")), grid)
    cells = stored(kept.groupBy(*codec.columns).agg(F.count("*").alias("n")).withColumn("rep", F.lit(1)))
    samples, decimated = seen_by(seen, "samples"), grid.t * grid.d
    top = codec.top(b).alias("unit")
    passes = cells.groupBy(top).agg(F.sum("n").alias("load"), F.count("*").alias("cells"))
    found = spacings(cells, codec, counted=True)
    classes = found.groupBy(CellCodec(codec.width, SPACING).low_bits(b).alias("unit")).agg(F.sum("n").alias("load"))
    each = passes.select(F.explode(F.array(
        F.struct(F.lit("pass").alias("kind"), "unit", F.col("cells").alias("load")), F.struct(F.lit("interval").alias("kind"), "unit", "load"))).alias("x")).select("x.*")
    each = each.unionByName(classes.select(F.lit("class").alias("kind"), "unit", "load"))
    cap = headroom_of(F.lit(samples), F.lit(decimated + b))
    return each.select("kind", "unit", "load", cap.alias("cap")).withColumn("alarm", F.col("load") > F.col("cap"))


# ----- shares of a run -----


class IncompleteRun(RuntimeError):
    """Units of a run are missing or there more than once."""


def share_units(b: int, shares: int, share: int) -> range:
    """The units of one of ``shares`` contiguous shares of 2^b."""
    return range((share << b) // shares, ((share + 1) << b) // shares)


def count_share(df: DataFrame, columns: list[str], grid: Grid, b: int, shares: int, share: int, mixed: bool = False, birthday: bool = False) -> DataFrame:
    """(share, unit, points, collisions) of every unit of a share, empty units included.

    Units are value intervals, or for the birthday-spacings test classes, whose points are their spacings; a share of
    classes looks at all points, since any two neighbours may belong to it.
    """
    codec, units = CellCodec(grid.width), share_units(b, shares, share)
    rows, unit = df, codec.top(b)
    if not mixed and not birthday and len(units):  # the share's range of the first column reaches the scan
        low = (units.start ^ (units.stop - 1)).bit_length()
        rows = in_pass(df, columns[0], grid, b - low, units.start >> low)
    kept = points(table_draws(rows, columns, mixed=mixed), grid).withColumn("rep", F.lit(1))
    if birthday:
        found = class_counts(spacings(kept, codec), codec.width, b).where((F.col("klass") >= units.start) & (F.col("klass") < units.stop))
        found = found.select(F.col("klass").alias("unit"), F.col("spacings").alias("points"), "collisions")
    else:
        found = pass_counts(kept.where((unit >= units.start) & (unit < units.stop)), codec, b).select(F.col("pass").alias("unit"), "points", "collisions")
    every = df.sparkSession.range(units.start, units.stop).select(F.col("id").alias("unit"))
    none = F.lit(0).cast("long")
    return every.join(found, "unit", "left").select(
        F.lit(share).alias("share"), "unit", F.coalesce("points", none).alias("points"), F.coalesce("collisions", none).alias("collisions"))


def append_share(units: DataFrame, path: str) -> None:
    """Write units of a run below ``path``, a folder a share.  Writing a share again replaces it, so a lost run is run again safely."""
    units.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("share").parquet(path)


_SHARE = "unit long, points long, collisions long, share int"


def shares_there(spark: SparkSession, path: str, b: int, shares: int) -> set[int]:
    """The shares whose units are all there."""
    append_share(spark.createDataFrame([], _SHARE), path)  # makes the folder before the first share
    kept = spark.read.schema(_SHARE).parquet(path)
    counts = {r["share"]: r["n"] for r in kept.groupBy("share").agg(F.countDistinct("unit").alias("n")).collect()}  # a row a share
    return {k for k in range(shares) if counts.get(k, 0) == len(share_units(b, shares, k))}


def run_shares(
    df: DataFrame, columns: list[str], grid: Grid, b: int, shares: int, path: str, mixed: bool = False, birthday: bool = False
) -> list[int]:
    """Count the shares that are not there yet, one after the other; what was counted before a driver was lost stays.  Returns them."""
    check_shares(shares, b)
    there = shares_there(df.sparkSession, path, b, shares)
    todo = [k for k in range(shares) if k not in there]
    for k in todo:
        append_share(count_share(df, columns, grid, b, shares, k, mixed, birthday), path)
    return todo


def combined(spark: SparkSession, path: str, grid: Grid, b: int, birthday: bool = False) -> DataFrame:
    """(points, collisions, mean, p_value, p_eps) of a whole run from its shares; units missing or doubled are an error."""
    kept = spark.read.schema(_SHARE).parquet(path)
    n = kept.agg(F.count("*").alias("rows"), F.countDistinct("unit").alias("units"), F.min("unit").alias("low"), F.max("unit").alias("high")).first()
    if (n["rows"], n["units"]) != (1 << b, 1 << b) or (n["low"], n["high"]) != (0, (1 << b) - 1):
        raise IncompleteRun(f"{n['units']} different units in {n['rows']} rows, not the {1 << b} of this run")
    whole = kept.agg(F.sum("points").alias("points"), F.sum("collisions").alias("collisions"))
    mean = birthday_mean_of if birthday else expected_collisions_of
    return with_p(whole.withColumn("mean", mean("points", 2.0**grid.width)))


def check_shares(shares: int, b: int) -> None:
    if not 1 <= shares <= 1 << b:
        raise SpecError(f"2^{b} units have between 1 and {1 << b} shares, not {shares}")
