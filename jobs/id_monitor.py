"""Identifier monitor: have the identifiers that were issued so far met as often as random ones would?

    python -m jobs.id_monitor --ids PATH --output PATH --checkpoint PATH [--config FILE]

A table of identifiers grows by files.  Each run takes the files that are new, as a stream that ends when it has them
all, and brings the collision counts of every value interval up to date.  The stream's checkpoint holds which files were
taken and each distinct point once; an interval's p-value near 0 says that its identifiers meet too often.

Output, Parquet below ``output``: ``changes``, partitioned by micro-batch, has the intervals that a batch changed and
their counts so far; ``state``, partitioned by alarm, has every interval's counts, mean, p-value, headroom and alarm as
of now.  A micro-batch that is run again replaces its own partition, and the state is made from the changes, so a run
that failed is run again safely and a run without new files changes nothing.

A point are the lowest ``bits`` bits of each of ``columns``, mixed first by a fixed bijection if ``mixed``, so that
counters look random; then equal points are equal identifiers or chance.  An alarm is a load that random points reach
with probability below 10^-1000.

Defined results: rows with a null in any of the columns are no points; repeated rows are points that meet; an empty
table gives an empty state; extra columns are not read.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from jobs.common import command_line, config_of, log, settings
from spacelab.functions.columns import expected_collisions_of, headroom_of, p_value_of
from spacelab.plans.spec import Grid, SpecError
from spacelab.plans.tables import seen_by
from spacelab.sources.table import table_draws
from spacelab.streaming.progress import change_writer, latest

CHANGES = "pass long, points long, collisions long, batch long"
STATE = "interval long, points long, collisions long, mean double, p_value double, cap long, alarm boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def pattern(path: str) -> str:
    """A pattern that only ``path`` matches: streams take folders and patterns, but no single file."""
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def report(changes: DataFrame, grid: Grid, b: int) -> DataFrame:
    """``STATE`` rows of the passes so far."""
    cells = 2.0 ** (grid.width - b)
    found = latest(changes).withColumn("mean", expected_collisions_of("points", cells))
    found = found.withColumn("p", p_value_of("collisions", "mean"))
    total = F.sum("points").over(Window.partitionBy(F.lit(0)))  # 2^b rows
    found = found.withColumn("total", total).withColumn("cap", headroom_of("total", F.lit(b)))
    return found.select(
        F.col("pass").alias("interval"), "points", "collisions", F.round("mean", 6).alias("mean"), F.round("p.value", 6).alias("p_value"), "cap",
        (F.col("points") > F.col("cap")).alias("alarm"))


def monitor(spark: SparkSession, ids: str, output: str, checkpoint: str, config: dict) -> DataFrame:
    """Take what is new and bring the output up to date; returns the state read back."""
    columns, bits, b = config["columns"], config["bits"], config["interval_bits"]
    grid = Grid(bits, len(columns), 64 - bits)
    if not 0 <= b <= min(grid.width, 16):
        raise SpecError(f"interval_bits = {b}: between 0 and {min(grid.width, 16)}")
    whole = spark.read.parquet(ids).select(*columns)
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(pattern(ids))
    with settings(spark, spark__sql__streaming__stateStore__providerClass=ROCKS):  # cells stay on disk, not in the heap
        writer = change_writer(table_draws(stream, columns, mixed=config["mixed"]), grid, f"{output}/changes", b)
        query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        finally:
            query.stop()
    batches = [p for p in query.recentProgress if p["numInputRows"]]
    # the stream reads its source once for the points and once for the new cells
    log.info("read %s new rows from %s in %s batches", sum(p["numInputRows"] for p in batches) // 2, ids, len(batches))
    # makes the folder where no batch has yet
    spark.createDataFrame([], CHANGES).write.mode("append").partitionBy("batch").parquet(f"{output}/changes")
    changes = spark.read.schema(CHANGES).parquet(f"{output}/changes")
    wrote = Observation()
    state = report(changes, grid, b).observe(wrote, F.count(F.lit(1)).alias("rows"), F.sum("points").alias("points"), F.count_if("alarm").alias("alarms"))
    state.coalesce(1).write.mode("overwrite").partitionBy("alarm").parquet(f"{output}/state")  # 2^b rows at most
    log.info("wrote %s intervals of %s points to %s, alarms: %s", seen_by(wrote, "rows"), seen_by(wrote, "points"), output, seen_by(wrote, "alarms"))
    return spark.read.schema(STATE).parquet(f"{output}/state")


def sql(config: dict) -> str:
    """The same state as SQL over the view events; ``mixed`` is the output function of SplitMix for the state that a value numbers."""
    b, bits, wide = config["interval_bits"], config["bits"], "CAST({} AS UHUGEINT)".format
    times = lambda x, k: f"CAST({wide(x)} * {wide(k)} % {wide(2**64)} AS UBIGINT)"

    def low(column: str) -> str:
        source = f"(SELECT row, CAST({column} AS UBIGINT) AS z FROM v)"
        if config["mixed"]:
            source = f"(SELECT row, {times('z', 0x9E3779B97F4A7C15)} AS z FROM {source})"
            for shift, k in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                source = f"(SELECT row, {times(f'xor(z, z >> {shift})', k)} AS z FROM {source})"
            source = f"(SELECT row, xor(z, z >> 31) AS z FROM {source})"
        return f"(SELECT row, CAST(z & {2**bits - 1} AS BIGINT) AS {column} FROM {source})"

    columns = config["columns"]
    width = bits * len(columns)
    cells = f"{2 ** (width - b)}.0"
    cell = " | ".join(f"({c} << {bits * (len(columns) - 1 - i)})" for i, c in enumerate(columns))
    joined = low(columns[0]) + "".join(f" JOIN {low(c)} USING (row)" for c in columns[1:])
    return f"""
WITH v AS (SELECT row_number() OVER () AS row, {", ".join(columns)} FROM events WHERE {" AND ".join(f"{c} IS NOT NULL" for c in columns)}),
k AS (SELECT cell, count(*) AS n FROM (SELECT {cell} AS cell FROM {joined}) GROUP BY cell),
c AS (SELECT cell >> {width - b} AS interval, sum(n) AS points, sum(n - 1) AS collisions FROM k GROUP BY ALL),
m AS (SELECT *, points - {cells} + {cells} * exp(points * ln(1 - 1 / {cells})) AS mean, sum(points) OVER () AS total, {b} * ln(2.0) + 1000 * ln(10.0) AS g FROM c),
p AS (SELECT interval, points, collisions, mean, total, g, sum(exp(k * ln(mean) - mean - lgamma(k + 1))) FILTER (k <= collisions) AS lo,
  sum(exp(k * ln(mean) - mean - lgamma(k + 1))) FILTER (k >= collisions) AS hi FROM m, (SELECT range AS k FROM range(0, 2000)) GROUP BY ALL),
r AS (SELECT *, CAST(least(total, ceil(total / {2**b}.0 + g / 3 + sqrt(g * g / 9 + 2 * total / {2**b}.0 * g))) AS BIGINT) AS cap FROM p)
SELECT CAST(interval AS BIGINT) AS interval, CAST(points AS BIGINT) AS points, CAST(collisions AS BIGINT) AS collisions, round(mean, 6) AS mean,
  round(CASE WHEN hi < lo THEN hi WHEN lo < 0.5 THEN 1 - lo ELSE 0.5 END, 6) AS p_value, cap, points > cap AS alarm FROM r"""


def run(spark: SparkSession, ids: str, output: str, checkpoint: str, config: str | None = None) -> None:
    monitor(spark, ids, output, checkpoint, config_of(Path(__file__), config))


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    return command_line("Identifier monitor: collisions of a growing table's identifiers", {
        "ids": "Parquet table that grows by files", "output": "folder to write", "checkpoint": "folder of the stream's checkpoint"}, run, arguments, spark)


if __name__ == "__main__":
    sys.exit(main())
