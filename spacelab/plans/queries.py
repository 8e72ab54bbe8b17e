"""Registered queries of the tests, on generated points and on the driver's tables, each with the same query as SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import birthday_mean_of, expected_collisions_of, headroom_of, p_value_of
from ..operators.cells import CellCodec, points
from ..operators.collisions import checkpoint_counts, histogram, pass_counts
from ..operators.prefix import running_sums
from ..operators.pruning import by_pass, in_pass
from ..operators.spacings import class_counts, interval_bits, spacings
from ..sources.generators import PHI, ROMU32, ROMU64, WY4_ADD, WY4_XOR, WY_ADD, WY_XOR
from ..sources.orbit import orbit
from ..sources.storage import delete_at_exit, shared_folder
from ..sources.table import table_draws
from ..streaming.progress import change_writer, latest
from .runner import execute, run_points
from .spec import Grid, Run
from .tables import combined, in_repetitions, load_report, ordered_draws, repetition_report, run_shares

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
M64 = 1 << 64


def _query(name: str, sql: str):
    def keep(make):
        QUERIES[name] = make
        ORACLE[name] = sql
        return make

    return keep


# ----- SQL text of the same arithmetic -----


def _wide(x: object) -> str:
    return f"CAST({x} AS UHUGEINT)"


def _mod(x: str, power: int = M64) -> str:
    return f"CAST(({x}) % {_wide(power)} AS UBIGINT)"


def _mul(x: str, k: int) -> str:
    return _mod(f"{_wide(x)} * {_wide(k)}")


def _splitmix_sql(source: str, state: str, keep: str) -> str:
    """SELECT with the columns ``keep`` and ``value``, SplitMix's output for the UBIGINT expression ``state``."""
    return f"""(SELECT {keep}, xor(z2, z2 >> 31) AS value FROM (SELECT *, {_mul('xor(z1, z1 >> 27)', 0x94D049BB133111EB)} AS z2 FROM (
      SELECT *, {_mul('xor(z0, z0 >> 30)', 0xBF58476D1CE4E5B9)} AS z1 FROM (SELECT *, {state} AS z0 FROM {source}))))"""


def _orbit_sql(seed: int, draws: int) -> str:
    """(n, value): draws of SplitMix."""
    return _splitmix_sql(f"(SELECT range AS n FROM range({draws}))", _mod(f"{_wide('n')} * {_wide(PHI)} + {_wide(seed)}"), "n")


def _points_sql(seed: int, samples: int, grid: Grid) -> str:
    """(sample, cell) of the kept samples of a two-dimensional grid of at most 62 bits."""
    e = f"CAST((value >> {64 - grid.u - grid.s}) & {(1 << grid.u) - 1} AS BIGINT)"
    low, step = (1 << grid.d) - 1, grid.u - grid.d
    kept = f"WHERE (e0 & {low}) = 0 AND (e1 & {low}) = 0" if grid.d else ""
    return f"""(SELECT sample, ((e0 >> {grid.d}) << {step}) | (e1 >> {grid.d}) AS cell FROM (
      SELECT n // 2 AS sample, max({e}) FILTER (n % 2 = 0) AS e0, max({e}) FILTER (n % 2 = 1) AS e1
      FROM {_orbit_sql(seed, 2 * samples)} GROUP BY n // 2) {kept})"""


def _spacings_sql(cells: str, width: int) -> str:
    return f"""(SELECT spacing FROM (
      SELECT cell - lag(cell) OVER (ORDER BY cell) AS spacing FROM {cells}) WHERE spacing IS NOT NULL
      UNION ALL SELECT {1 << width} - max(cell) + min(cell) FROM {cells} HAVING max(cell) > min(cell))"""


def _collisions_sql(cells: str, key: str = "0") -> str:
    return f"""SELECT CAST({key} AS BIGINT) AS pass, CAST(sum(n) AS BIGINT) AS points, CAST(sum(n - 1) AS BIGINT) AS collisions
      FROM (SELECT cell, count(*) AS n FROM {cells} GROUP BY cell) GROUP BY 1"""


# ----- collision tests -----

PLAIN = Run(Grid(16, 2), m=1 << 18, seed=0xABCD123456789ABC)


@_query("collision_plain", _collisions_sql(_points_sql(PLAIN.seed, PLAIN.samples, PLAIN.grid)))
def collision_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pass_counts(run_points(spark, PLAIN), CellCodec(32)).drop("rep")


def _one(kept: DataFrame) -> DataFrame:
    return kept.withColumn("rep", F.lit(1))


def _table(spark: SparkSession, sf_dir: str, name: str, columns: list[str], grid: Grid, order: str | None = None, mixed: bool = False) -> DataFrame:
    return _one(points(table_draws(spark.read.parquet(f"{sf_dir}/{name}.parquet"), columns, order, mixed), grid))


_ORDERS_MIXED = f"(SELECT o_orderkey, CAST(value >> 40 AS BIGINT) AS cell FROM {_splitmix_sql('orders', _mod(f'{_wide('o_orderkey')} * {_wide(PHI)}'), 'o_orderkey')})"


@_query("collision_orders", _collisions_sql(_ORDERS_MIXED))
def collision_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pass_counts(_table(spark, sf_dir, "orders", ["o_orderkey"], Grid(24, 1), mixed=True), CellCodec(24)).drop("rep")


_LINES = "(SELECT ((l_partkey & 1023) << 10) | (l_suppkey & 1023) AS cell FROM lineitem)"
LINE_GRID = Grid(10, 2, 54)


@_query("collision_lineitem", _collisions_sql(_LINES))
def collision_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pass_counts(_table(spark, sf_dir, "lineitem", ["l_partkey", "l_suppkey"], LINE_GRID), CellCodec(20)).drop("rep")


@_query("collision_tradeoff_passes", f"""
SELECT *, CAST(sum(points) OVER (ORDER BY pass) AS BIGINT) AS cum_points, CAST(sum(collisions) OVER (ORDER BY pass) AS BIGINT) AS cum_collisions
FROM ({_collisions_sql(_LINES, "cell >> 16")})""")
def collision_tradeoff_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pass_counts(_table(spark, sf_dir, "lineitem", ["l_partkey", "l_suppkey"], LINE_GRID), CellCodec(20), 4)
    so_far = Window.partitionBy("rep").orderBy("pass").rowsBetween(Window.unboundedPreceding, 0)
    return found.select("pass", "points", "collisions", F.sum("points").over(so_far).alias("cum_points"), F.sum("collisions").over(so_far).alias("cum_collisions"))


@_query("collision_single_pass", f"SELECT * FROM ({_collisions_sql(_ORDERS_MIXED, 'cell >> 21')}) WHERE pass = 5")
def collision_single_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pass_counts(_table(spark, sf_dir, "orders", ["o_orderkey"], Grid(24, 1), mixed=True), CellCodec(24), 3, only=5).drop("rep")


@_query("collision_decimated", _collisions_sql(
    "(SELECT ((l_orderkey & 4095) >> 1 << 11) | ((l_partkey & 4095) >> 1) AS cell FROM lineitem WHERE l_orderkey % 2 = 0 AND l_partkey % 2 = 0)"))
def collision_decimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pass_counts(_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey"], Grid(12, 2, 52, 1)), CellCodec(22)).drop("rep")


STAGED = Run(Grid(10, 2, d=2), m=6000, checkpoints=True, seed=7)


@_query("collision_checkpoints", f"""
WITH p AS (SELECT sample, cell, row_number() OVER (PARTITION BY cell ORDER BY sample) > 1 AS again FROM {_points_sql(7, STAGED.samples, STAGED.grid)}),
s AS (SELECT range AS stage, {STAGED.samples} * range // {len(STAGED.stages())} AS until FROM range(1, {len(STAGED.stages()) + 1}))
SELECT stage, count(*) AS points, CAST(sum(CAST(again AS INTEGER)) AS BIGINT) AS collisions FROM s JOIN p ON p.sample < s.until GROUP BY stage""")
def collision_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpoint_counts(run_points(spark, STAGED), CellCodec(STAGED.grid.width), STAGED.samples, len(STAGED.stages())).drop("rep")


@_query("checkpoints_orders", """
WITH p AS (SELECT o_orderkey AS j, (o_custkey & 255) >> 1 AS cell FROM orders WHERE o_custkey % 2 = 0),
q AS (SELECT j, row_number() OVER (PARTITION BY cell ORDER BY j) > 1 AS again FROM p),
s AS (SELECT range AS stage, (SELECT max(o_orderkey) + 1 FROM orders) * range // 64 AS until FROM range(1, 65))
SELECT stage, count(*) AS points, CAST(sum(CAST(again AS INTEGER)) AS BIGINT) AS collisions FROM s JOIN q ON q.j < s.until GROUP BY stage""")
def checkpoints_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _table(spark, sf_dir, "orders", ["o_custkey"], Grid(8, 1, 56, 1), order="o_orderkey")
    samples = (spark.read.parquet(f"{sf_dir}/orders.parquet").agg(F.max("o_orderkey")).first()[0] or 0) + 1
    return checkpoint_counts(kept, CellCodec(7), samples, 64).where("points > 0").drop("rep")


REPEATED = Run(Grid(8, 2), m=4000, reps=3, seed=12345)


@_query("collision_reps", f"""
SELECT CAST(rep AS INTEGER) AS rep, CAST(sum(n) AS BIGINT) AS points, CAST(sum(n - 1) AS BIGINT) AS collisions FROM (
  SELECT sample // {REPEATED.samples} + 1 AS rep, cell, count(*) AS n FROM {_points_sql(12345, 3 * REPEATED.samples, REPEATED.grid)} GROUP BY 1, 2) GROUP BY rep""")
def collision_reps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pass_counts(run_points(spark, REPEATED), CellCodec(16)).drop("pass")


@_query("cell_histogram", "SELECT CAST((c_custkey & 65535) >> 11 AS BIGINT) AS pass, count(*) AS points FROM customer GROUP BY 1")
def cell_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(_table(spark, sf_dir, "customer", ["c_custkey"], Grid(16, 1, 48)), CellCodec(16), 5).drop("rep")


# ----- birthday-spacings tests -----


def _classes(kept: DataFrame, width: int, count: int, b: int = 0, only: int | None = None) -> DataFrame:
    codec = CellCodec(width)
    return class_counts(spacings(kept, codec, interval_bits(codec, count, target=4096)), width, b, only).drop("rep")


def _classes_sql(cells: str, width: int, b: int = 0) -> str:
    return f"""SELECT spacing & {(1 << b) - 1} AS klass, CAST(sum(n) AS BIGINT) AS spacings, CAST(sum(n - 1) AS BIGINT) AS collisions
      FROM (SELECT CAST(spacing AS BIGINT) AS spacing, count(*) AS n FROM {_spacings_sql(cells, width)} GROUP BY 1) GROUP BY 1"""


_EVENTS = "(SELECT ((event_id & 4095) << 12) | (user_id & 4095) AS cell FROM events)"


@_query("birthday_plain", _classes_sql("(SELECT cell FROM " + _ORDERS_MIXED + ")", 24))
def birthday_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classes(_table(spark, sf_dir, "orders", ["o_orderkey"], Grid(24, 1), mixed=True), 24, 1 << 16)


@_query("birthday_classes", _classes_sql(_EVENTS, 24, 3))
def birthday_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classes(_table(spark, sf_dir, "events", ["event_id", "user_id"], Grid(12, 2, 52)), 24, 1 << 16, 3)


@_query("birthday_single_class", f"SELECT * FROM ({_classes_sql(_EVENTS, 24, 3)}) WHERE klass = 2")
def birthday_single_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classes(_table(spark, sf_dir, "events", ["event_id", "user_id"], Grid(12, 2, 52)), 24, 1 << 16, 3, only=2)


SPARSE = Run(Grid(10, 2, d=2), m=250, b=4, birthday=True, seed=99)


@_query("birthday_decimated", _classes_sql(_points_sql(99, SPARSE.samples, SPARSE.grid), 16, 4))
def birthday_decimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classes(run_points(spark, SPARSE), 16, SPARSE.points, 4)


@_query("spacings_lineitem", f"SELECT CAST(spacing AS BIGINT) AS spacing, count(*) AS n FROM {_spacings_sql(_LINES, 20)} GROUP BY 1")
def spacings_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spacings(_table(spark, sf_dir, "lineitem", ["l_partkey", "l_suppkey"], LINE_GRID), CellCodec(20), 4)
    return found.groupBy("spacing").agg(F.sum("n").alias("n"))


# ----- whole runs, as the command line makes them -----


def _units(spark: SparkSession, run: Run, source: DataFrame | None = None) -> DataFrame:
    """What ``execute`` counts: rep, unit, points, collisions."""
    return execute(spark, run, source).units_frame(spark).select("rep", "unit", "points", "collisions")


def _units_sql(units: int, body: str) -> str:
    """``body`` has unit, points and collisions; units without points are listed too."""
    return f"""SELECT CAST(1 AS INTEGER) AS rep, CAST(range AS BIGINT) AS unit, CAST(coalesce(points, 0) AS BIGINT) AS points, CAST(coalesce(collisions, 0) AS BIGINT) AS collisions
      FROM range({units}) LEFT JOIN (SELECT * FROM ({body}) AS b(unit, points, collisions)) ON unit = range"""


PACKED = Run(Grid(16, 2), m=1 << 16, b=2, seed=0xABCD123456789ABC)
PACKED_SQL = _units_sql(4, _collisions_sql(_points_sql(PACKED.seed, PACKED.samples, PACKED.grid), "cell >> 30"))


@_query("packed_collision", PACKED_SQL)
def packed_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _units(spark, PACKED)


@_query("packed_collision_replay", PACKED_SQL)
def packed_collision_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pass in a scan of its own."""
    return _units(spark, replace(PACKED, replay=True))


@_query("packed_collision_single_pass", f"SELECT * FROM ({PACKED_SQL}) WHERE unit = 2")
def packed_collision_single_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _units(spark, replace(PACKED, only=2))


THINNED = Run(Grid(14, 2, d=2), m=4096, b=2, seed=0x0DEC1A7E00000002)


@_query("packed_collision_decimated", _units_sql(4, _collisions_sql(_points_sql(THINNED.seed, THINNED.samples, THINNED.grid), "cell >> 22")))
def packed_collision_decimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _units(spark, THINNED)


PACKED_BIRTHDAY = Run(Grid(20, 2), m=10000, b=2, birthday=True, seed=0x0B174DA900000002)
PACKED_BIRTHDAY_SQL = _units_sql(4, _classes_sql(_points_sql(PACKED_BIRTHDAY.seed, PACKED_BIRTHDAY.samples, PACKED_BIRTHDAY.grid), 40, 2))


@_query("packed_birthday", PACKED_BIRTHDAY_SQL)
def packed_birthday(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _units(spark, PACKED_BIRTHDAY)


@_query("packed_birthday_single_class", f"SELECT * FROM ({PACKED_BIRTHDAY_SQL}) WHERE unit = 1")
def packed_birthday_single_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _units(spark, replace(PACKED_BIRTHDAY, only=1))


STAGED_RUN = Run(Grid(16, 2, d=2), m=16384, checkpoints=True, seed=0x0C0C0C0C00000001)


@_query("run_checkpoints", f"""
WITH p AS (SELECT sample, cell, row_number() OVER (PARTITION BY cell ORDER BY sample) > 1 AS again FROM {_points_sql(STAGED_RUN.seed, STAGED_RUN.samples, STAGED_RUN.grid)}),
s AS (SELECT range AS stage, {STAGED_RUN.samples} * range // 4 AS until FROM range(1, 5))
SELECT CAST(1 AS INTEGER) AS rep, stage AS unit, count(*) AS points, CAST(sum(CAST(again AS INTEGER)) AS BIGINT) AS collisions FROM s JOIN p ON p.sample < s.until GROUP BY stage""")
def run_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _units(spark, STAGED_RUN)


def _steps_points_sql(name: str, samples: int, grid: Grid) -> str:
    """(sample, cell) of two-dimensional samples of a generator that SQL steps one by one."""
    e = f"CAST(CAST('0x' || value AS UBIGINT) >> {64 - grid.u} AS BIGINT)"
    return f"""(SELECT n // 2 AS sample, (max({e}) FILTER (n % 2 = 0) << {grid.u}) | max({e}) FILTER (n % 2 = 1) AS cell FROM ({ORACLE[name]}) WHERE n < {2 * samples} GROUP BY 1)"""


STEPPED = Run(Grid(7, 2), m=1200, b=1, seed=0x0123456789ABCDEF)


def _add_stepped(kind: str, generator: str) -> None:
    """Collisions and spacings of a generator that walks or jumps, over several lanes."""
    cells = _steps_points_sql("gen_" + generator, STEPPED.samples, STEPPED.grid)
    run = replace(STEPPED, generator=generator)
    QUERIES[f"run_{kind}_collision"] = lambda spark, sf_dir: _units(spark, run)
    ORACLE[f"run_{kind}_collision"] = _units_sql(2, _collisions_sql(cells, "cell >> 13"))
    QUERIES[f"run_{kind}_birthday"] = lambda spark, sf_dir: _units(spark, replace(run, birthday=True))
    ORACLE[f"run_{kind}_birthday"] = _units_sql(2, _classes_sql(cells, 14, 1))


# cells of more than 64 bits: two columns in Spark, one 128-bit number in SQL

_WIDE_GRID = Grid(40, 2, 24)
_WIDE_LINES = "(SELECT CAST(l_partkey AS HUGEINT) * 1099511627776 + l_suppkey AS cell FROM lineitem)"


def _wide_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return table_draws(lines, ["l_partkey", "l_suppkey"]), lines.count()


@_query("wide_collision", f"SELECT CAST(1 AS INTEGER) AS rep, pass AS unit, points, collisions FROM ({_collisions_sql(_WIDE_LINES)})")
def wide_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws, count = _wide_lines(spark, sf_dir)
    return _units(spark, Run(_WIDE_GRID, m=count), draws)


@_query("wide_birthday", f"""WITH s AS {_spacings_sql(_WIDE_LINES, 80)}
SELECT CAST(1 AS INTEGER) AS rep, CAST(k AS BIGINT) AS unit, CAST(sum(n) AS BIGINT) AS points, CAST(sum(n - 1) AS BIGINT) AS collisions
FROM (SELECT spacing % 4 AS k, spacing, count(*) AS n FROM s GROUP BY spacing) GROUP BY k""")
def wide_birthday(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws, count = _wide_lines(spark, sf_dir)
    return _units(spark, Run(_WIDE_GRID, m=-(-count // 4), b=2, birthday=True), draws)


WIDEST = Run(Grid(64, 2), m=1000, b=2, birthday=True, seed=7)


@_query("widest_birthday", f"""WITH c AS (
  SELECT max({_wide('value')}) FILTER (n % 2 = 0) * {_wide(M64)} + max({_wide('value')}) FILTER (n % 2 = 1) AS cell FROM {_orbit_sql(7, 2 * WIDEST.samples)} GROUP BY n // 2),
s AS (SELECT spacing FROM (SELECT cell - lag(cell) OVER (ORDER BY cell) AS spacing FROM c) WHERE spacing IS NOT NULL
      UNION ALL SELECT {_wide(2**128 - 1)} - max(cell) + min(cell) + {_wide(1)} FROM c)
SELECT CAST(1 AS INTEGER) AS rep, CAST(k AS BIGINT) AS unit, CAST(sum(n) AS BIGINT) AS points, CAST(sum(n - 1) AS BIGINT) AS collisions
FROM (SELECT spacing % {_wide(4)} AS k, spacing, count(*) AS n FROM s GROUP BY spacing) GROUP BY k""")
def widest_birthday(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _units(spark, WIDEST)


# ----- statistics -----


def _line_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pass_counts(_table(spark, sf_dir, "lineitem", ["l_partkey", "l_suppkey"], LINE_GRID), CellCodec(20), 4)


@_query("expected_collisions_table", f"""
WITH c AS ({_collisions_sql(_LINES, "cell >> 16")})
SELECT pass, points, round(CASE WHEN points <= 1 THEN 0 ELSE points - 65536 + 65536 * exp(points * ln(1 - 1 / 65536.0)) END, 6) AS expected FROM c""")
def expected_collisions_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_passes(spark, sf_dir).select("pass", "points", F.round(expected_collisions_of("points", 65536), 6).alias("expected"))


@_query("p_values", f"""
WITH c AS ({_collisions_sql(_ORDERS_MIXED, "cell >> 20")}),
e AS (SELECT pass, collisions, points - 1048576 + 1048576 * exp(points * ln(1 - 1 / 1048576.0)) AS mean FROM c),
t AS (SELECT pass, collisions, sum(exp(k * ln(mean) - mean - lgamma(k + 1))) FILTER (k <= collisions) AS lo,
             sum(exp(k * ln(mean) - mean - lgamma(k + 1))) FILTER (k >= collisions) AS hi
      FROM e, (SELECT range AS k FROM range(0, 400)) GROUP BY pass, collisions)
SELECT pass, collisions, round(CASE WHEN hi < lo THEN hi WHEN lo < 0.5 THEN 1 - lo ELSE 0.5 END, 6) AS p_value FROM t""")
def p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _table(spark, sf_dir, "orders", ["o_orderkey"], Grid(24, 1), mixed=True)
    found = pass_counts(kept, CellCodec(24), 4).withColumn("mean", expected_collisions_of("points", 1 << 20))
    return found.withColumn("p", p_value_of("collisions", "mean")).select("pass", "collisions", F.round("p.value", 6).alias("p_value"))


@_query("birthday_means", f"""
WITH c AS ({_collisions_sql(_LINES, "cell >> 16")})
SELECT pass, points, CAST(points AS DOUBLE) * points * points / (4 * pow(2, 30 + pass)) AS mean FROM c""")
def birthday_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_passes(spark, sf_dir).select("pass", "points", birthday_mean_of("points", F.pow(F.lit(2.0), F.col("pass") + 30)).alias("mean"))


@_query("headroom_table", f"""
WITH c AS ({_collisions_sql(_LINES, "cell >> 16")}),
m AS (SELECT pass, points, pass + 1 AS bits, points / pow(2, pass + 1) AS mean, (pass + 1) * ln(2.0) + 1000 * ln(10.0) AS l FROM c)
SELECT pass, points, CAST(least(points, ceil(mean + l / 3 + sqrt(l * l / 9 + 2 * mean * l))) AS BIGINT) AS headroom FROM m""")
def headroom_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_passes(spark, sf_dir).select("pass", "points", headroom_of("points", F.col("pass") + 1).alias("headroom"))


# ----- tables: values of any distribution, samples in any order, reports of any number of units -----


def _classes_of(cells: str, width: int, b: int) -> str:
    return f"SELECT * FROM ({_classes_sql(cells, width, b)})"


@_query("birthday_orders_keys", _classes_of("(SELECT o_orderkey & 1099511627775 AS cell FROM orders)", 40, 2))
def birthday_orders_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys as they are: all in the lowest part of the cells."""
    kept = _table(spark, sf_dir, "orders", ["o_orderkey"], Grid(40, 1, 24))
    return class_counts(spacings(kept, CellCodec(40)), 40, 2).drop("rep")


_HOT = "(SELECT CASE WHEN l_linenumber <= 2 THEN 77 ELSE l_orderkey * 8 + l_linenumber END & 1099511627775 AS cell FROM lineitem)"


@_query("birthday_hot_key", _classes_of(_HOT, 40, 3))
def birthday_hot_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key that a third of all rows or more have."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    key = F.when(F.col("l_linenumber") <= 2, F.lit(77).cast("long")).otherwise(F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    kept = _one(points(table_draws(lines.select(key.alias("key")), ["key"]), Grid(40, 1, 24)))
    return class_counts(spacings(kept, CellCodec(40)), 40, 3).drop("rep")


_FULL = f"(SELECT {_wide('l_orderkey')} * {_wide(M64)} + {_wide('l_partkey * 8 + l_linenumber')} AS cell FROM lineitem)"


@_query("birthday_lineitem_128_bits", f"""WITH c AS {_FULL},
s AS (SELECT spacing FROM (SELECT cell - lag(cell) OVER (ORDER BY cell) AS spacing FROM c) WHERE spacing IS NOT NULL
      UNION ALL SELECT {_wide(2**128 - 1)} - max(cell) + min(cell) + {_wide(1)} FROM c HAVING max(cell) > min(cell))
SELECT CAST(k AS BIGINT) AS klass, CAST(sum(n) AS BIGINT) AS spacings, CAST(sum(n - 1) AS BIGINT) AS collisions
FROM (SELECT spacing % {_wide(8)} AS k, spacing, count(*) AS n FROM s GROUP BY spacing) GROUP BY k""")
def birthday_lineitem_128_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of 128 bits from two whole columns; most rows share their upper words' leading bits."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", (F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("low"))
    kept = _one(points(table_draws(lines, ["l_orderkey", "low"]), Grid(64, 2)))
    return class_counts(spacings(kept, CellCodec(128)), 128, 3).drop("rep")


def _ordered(spark: SparkSession, sf_dir: str, name: str, columns: list[str], order: list[str], grid: Grid) -> tuple[DataFrame, int]:
    draws, samples = ordered_draws(spark.read.parquet(f"{sf_dir}/{name}.parquet"), columns, order)
    return points(draws, grid), samples


def _stages_sql(rows: str, stages: int) -> str:
    """Checkpoints of ``rows`` (sample, cell) by sums over the stages; ``cell`` is null where a sample is not kept."""
    return f"""WITH r AS {rows}, z AS (SELECT max(sample) + 1 AS n FROM r),
p AS (SELECT ((sample + 1) * {stages} + z.n - 1) // z.n AS stage, row_number() OVER (PARTITION BY cell ORDER BY sample) > 1 AS again FROM r, z WHERE cell IS NOT NULL),
c AS (SELECT stage, count(*) AS n, count_if(again) AS again FROM p GROUP BY stage)
SELECT CAST(range AS BIGINT) AS stage, CAST(coalesce(sum(n) OVER (ORDER BY range), 0) AS BIGINT) AS points, CAST(coalesce(sum(again) OVER (ORDER BY range), 0) AS BIGINT) AS collisions
FROM range(1, {stages + 1}) LEFT JOIN c ON stage = range"""


@_query("checkpoints_events_by_time", _stages_sql(
    "(SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS sample, CASE WHEN user_id % 2 = 0 THEN (user_id & 4095) >> 1 END AS cell FROM events)", 100))
def checkpoints_events_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, samples = _ordered(spark, sf_dir, "events", ["user_id"], ["ts", "event_id"], Grid(12, 1, 52, 1))
    return checkpoint_counts(kept.withColumn("rep", F.lit(1)), CellCodec(11), samples, 100).drop("rep")


_BY_DATE = "row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1"
_DATE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@_query("checkpoints_lineitem_by_date", _stages_sql(
    f"(SELECT {_BY_DATE} AS sample, CASE WHEN l_partkey % 2 = 0 AND l_suppkey % 2 = 0 THEN ((l_partkey & 1023) >> 1 << 9) | ((l_suppkey & 1023) >> 1) END AS cell FROM lineitem)", 32))
def checkpoints_lineitem_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, samples = _ordered(spark, sf_dir, "lineitem", ["l_partkey", "l_suppkey"], _DATE_ORDER, Grid(10, 2, 54, 1))
    return checkpoint_counts(_one(kept), CellCodec(18), samples, 32).drop("rep")


MANY_STAGES = 1 << 20


@_query("checkpoints_lineitem_many_stages", _stages_sql(
    f"(SELECT {_BY_DATE} AS sample, CASE WHEN l_orderkey % 2 = 0 THEN (l_orderkey & 65535) >> 1 END AS cell FROM lineitem)", MANY_STAGES))
def checkpoints_lineitem_many_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, samples = _ordered(spark, sf_dir, "lineitem", ["l_orderkey"], _DATE_ORDER, Grid(16, 1, 48, 1))
    return checkpoint_counts(_one(kept), CellCodec(15), samples, MANY_STAGES).drop("rep")


_EXPECTED_SQL = "CASE WHEN points <= 1 THEN 0 ELSE points - 4096 + 4096 * exp(points * ln(1 - 1 / 4096.0)) END"


@_query("repetitions_orders", f"""
WITH r AS (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS j, count(*) OVER () AS n, o_custkey FROM orders),
k AS (SELECT CASE WHEN j < (n % 3) * (n // 3 + 1) THEN j // (n // 3 + 1) ELSE n % 3 + (j - (n % 3) * (n // 3 + 1)) // (n // 3) END + 1 AS rep, (o_custkey & 8191) >> 1 AS cell FROM r WHERE o_custkey % 2 = 0),
c AS (SELECT rep, sum(n) AS points, sum(n - 1) AS collisions FROM (SELECT rep, cell, count(*) AS n FROM k GROUP BY ALL) GROUP BY rep),
m AS (SELECT rep, points, collisions, {_EXPECTED_SQL} AS mean FROM c)
SELECT CAST(rep AS INTEGER) AS rep, CAST(points AS BIGINT) AS points, CAST(collisions AS BIGINT) AS collisions, round(mean, 6) AS mean, CAST(sum(points) OVER w AS BIGINT) AS cum_points,
  CAST(sum(collisions) OVER w AS BIGINT) AS cum_collisions, round(sum(mean) OVER w, 6) AS cum_mean FROM m WINDOW w AS (ORDER BY rep)""")
def repetitions_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three contiguous segments of the orders by date, each with the mean of the points that it keeps."""
    kept, samples = _ordered(spark, sf_dir, "orders", ["o_custkey"], ["o_orderdate", "o_orderkey"], Grid(13, 1, 51, 1))
    found = repetition_report(in_repetitions(kept, samples, 3), CellCodec(12))
    return found.select("rep", "points", "collisions", F.round("mean", 6).alias("mean"), "cum_points", "cum_collisions", F.round("cum_mean", 6).alias("cum_mean"))


MANY_PASSES = 22
_MANY_CELLS = "(SELECT ((l_orderkey & 4095) << 12) | (l_partkey & 4095) AS cell FROM lineitem)"


@_query("passes_lineitem_many", f"""
SELECT *, CAST(sum(points) OVER (ORDER BY pass) AS BIGINT) AS cum_points, CAST(sum(collisions) OVER (ORDER BY pass) AS BIGINT) AS cum_collisions
FROM ({_collisions_sql(_MANY_CELLS, f"cell >> {24 - MANY_PASSES}")})""")
def passes_lineitem_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2^22 passes with what has added up so far."""
    kept = _table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey"], Grid(12, 2, 52))
    return running_sums(pass_counts(kept, CellCodec(24), MANY_PASSES), ["rep"], "pass", {"cum_points": "points", "cum_collisions": "collisions"}, top=MANY_PASSES).drop("rep")


PRUNED = Grid(24, 1, 40)


@_query("collision_pruned_pass", f"SELECT * FROM ({_collisions_sql('(SELECT o_orderkey & 16777215 AS cell FROM orders)', 'cell >> 12')}) WHERE pass = 1")
def collision_pruned_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass of raw keys; its range reaches the scan."""
    orders = in_pass(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey", PRUNED, 12, 1)
    return pass_counts(_one(points(table_draws(orders, ["o_orderkey"]), PRUNED)), CellCodec(24), 12, only=1).drop("rep")


@_query("replay_lineitem", _collisions_sql(_LINES, "cell >> 17"))
def replay_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pass counted from its own folder of a table of cells written by pass."""
    kept = by_pass(_table(spark, sf_dir, "lineitem", ["l_partkey", "l_suppkey"], LINE_GRID), CellCodec(20), 3)
    parts = [pass_counts(kept.where(F.col("pass") == k).drop("pass"), CellCodec(20), 3).drop("rep") for k in range(8)]
    return reduce(DataFrame.unionByName, parts)


@_query("loads_lineitem", f"""
WITH c AS {_LINES}, d AS (SELECT cell, count(*) AS n FROM c GROUP BY cell),
l AS (SELECT 'pass' AS kind, cell >> 16 AS unit, count(*) AS load FROM d GROUP BY ALL UNION ALL SELECT 'interval', cell >> 16, sum(n) FROM d GROUP BY ALL
  UNION ALL SELECT 'class', spacing & 15, count(*) FROM (SELECT CAST(spacing AS BIGINT) AS spacing FROM {_spacings_sql('c', 20)}) GROUP BY ALL),
m AS (SELECT count(*) AS n, 4 * ln(2.0) + 1000 * ln(10.0) AS g FROM c)
SELECT kind, CAST(unit AS BIGINT) AS unit, CAST(load AS BIGINT) AS load, cap, load > cap AS alarm
FROM l, (SELECT CAST(least(n, ceil(n / 16.0 + g / 3 + sqrt(g * g / 9 + 2 * n / 16.0 * g))) AS BIGINT) AS cap FROM m)""")
def loads_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return load_report(table_draws(lines, ["l_partkey", "l_suppkey"]), LINE_GRID, 4)


@_query("shares_orders", f"""
WITH c AS ({_collisions_sql('(SELECT o_custkey & 16383 AS cell FROM orders)')})
SELECT points, collisions, round(points - 16384 + 16384 * exp(points * ln(1 - 1 / 16384.0)), 6) AS mean FROM c""")
def shares_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of 64 units in five shares, counted one after the other, kept, and combined."""
    path = f"{shared_folder(spark)}/shares-{uuid.uuid4().hex}"
    grid = Grid(14, 1, 50)
    delete_at_exit(spark, path)
    run_shares(spark.read.parquet(f"{sf_dir}/orders.parquet"), ["o_custkey"], grid, 6, 5, path)
    return combined(spark, path, grid, 6).select("points", "collisions", F.round("mean", 6).alias("mean"))


@_query("shares_events_spacings", f"""
WITH c AS ({_classes_sql(_EVENTS, 24)})
SELECT CAST(spacings AS BIGINT) AS points, collisions, round(CAST(spacings AS DOUBLE) * spacings * spacings / (4 * pow(2, 24)), 6) AS mean FROM c""")
def shares_events_spacings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spacing classes of the events in two shares, combined."""
    path = f"{shared_folder(spark)}/shares-{uuid.uuid4().hex}"
    delete_at_exit(spark, path)
    grid = Grid(12, 2, 52)
    run_shares(spark.read.parquet(f"{sf_dir}/events.parquet"), ["event_id", "user_id"], grid, 4, 2, path, birthday=True)
    return combined(spark, path, grid, 4, birthday=True).select("points", "collisions", F.round("mean", 6).alias("mean"))


@_query("stream_events", _collisions_sql("(SELECT ((event_id & 255) << 8) | (user_id & 255) AS cell FROM events)", "cell >> 13"))
def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events dealt into six files and read as a stream of one file a batch; the last change of each pass."""
    place, grid = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}", Grid(8, 2, 56)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    events.repartition(6, "event_id").write.parquet(f"{place}/in")
    delete_at_exit(spark, place)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
    writer = change_writer(table_draws(stream, ["event_id", "user_id"]), grid, f"{place}/out", 3)
    writer.option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return latest(spark.read.schema("pass long, points long, collisions long, batch long").parquet(f"{place}/out"))


# ----- generators: the first draws, as hexadecimal text -----

DRAWS = 5000  # several lanes of the generators that are stepped
SEED = 0x0123456789ABCDEF


def _hex(x: Column) -> Column:
    return F.lower(F.lpad(F.hex(x), 16, "0"))


def _draws(name: str):
    def make(spark: SparkSession, sf_dir: str) -> DataFrame:
        return orbit(spark, name, SEED, DRAWS, 1).select(F.col("sample_id").alias("n"), _hex(F.col("draw_0")).alias("value"))

    return make


def _add_generator(name: str, sql: str) -> None:
    key = "gen_" + name.lower().replace("-", "_")
    QUERIES[key], ORACLE[key] = _draws(name), sql


_SHOWN = "CAST(n AS BIGINT) AS n, lpad(lower(to_hex(value)), 16, '0') AS value"


def _counter_sql(value: str) -> str:
    """``value``, an expression over n."""
    return f"SELECT {_SHOWN} FROM (SELECT n, {value} AS value FROM (SELECT range AS n FROM range({DRAWS})))"


def _fold_sql(a: str, b: str) -> str:
    """xor of the halves of a 128-bit product of two UBIGINT."""
    product = f"{_wide(a)} * {_wide(b)}"
    return f"xor(CAST(({product}) // {_wide(M64)} AS UBIGINT), {_mod(product)})"


def _state(increment: int, plus: int = 0) -> str:
    return _mod(f"{_wide(SEED)} + {_wide(f'(n + {plus})')} * {_wide(increment)}")


def _ubig(x: int) -> str:
    return f"CAST({x} AS UBIGINT)"


_add_generator("splitmix", f"SELECT {_SHOWN} FROM {_orbit_sql(SEED, DRAWS)}")
_add_generator("incr", _counter_sql(_state(1, 1)))
_add_generator("wyrand", _counter_sql(_fold_sql(f"xor({_state(WY_ADD)}, {_ubig(WY_XOR)})", _state(WY_ADD))))
_add_generator("wyrand-next", _counter_sql(_fold_sql(f"xor({_state(WY_ADD)}, {_ubig(WY_XOR)})", _state(WY_ADD, 1))))
_add_generator("wyrand-v4", _counter_sql(_fold_sql(_state(WY4_ADD, 1), f"xor({_state(WY4_ADD, 1)}, {_ubig(WY4_XOR)})")))
_WIDE_LOW = f"({_wide(SEED)} + {_wide('(n + 1)')} * {_wide(WY4_XOR)})"
_WIDE_HIGH = _mod(f"{_WIDE_LOW} // {_wide(M64)} + {_wide('(n + 1)')} * {_wide(WY4_ADD)}")
_add_generator("wyrand128", _counter_sql(_fold_sql(_mod(_WIDE_LOW), f"xor({_WIDE_HIGH}, {_mod(_WIDE_LOW)})")))


def _steps_sql(columns: dict[str, str], first: dict[str, int], output: str) -> str:
    """A recursive walk: the next value of each state column, its first value, and the output before the step."""
    names = list(columns)
    start = ", ".join(f"{_wide(first[c])} AS {c}" for c in names)
    move = ", ".join(columns[c] for c in names)
    return f"""WITH RECURSIVE w(n, {', '.join(names)}) AS (SELECT 0, {start} UNION ALL SELECT n + 1, {move} FROM w WHERE n < {DRAWS})
      SELECT {_SHOWN} FROM (SELECT n, CAST({output} AS UBIGINT) AS value FROM w WHERE n < {DRAWS})"""


def _rot_sql(x: str, n: int, bits: int = 64) -> str:
    return f"(({x}) * {_wide(1 << n)} % {_wide(1 << bits)} + ({x}) // {_wide(1 << (bits - n))})"


def _minus_sql(a: str, b: str, bits: int = 64) -> str:
    return f"((({a}) + {_wide(1 << bits)} - ({b})) % {_wide(1 << bits)})"


for _name, _a, _bits in (("lcg_64_64_0xa5b9ee81534fa94d", 0xA5B9EE81534FA94D, 64), ("lcg_32_32_0xec65035", 0xEC65035, 32), ("lcg_32_32_0x915f77f5", 0x915F77F5, 32)):
    _next = f"((x * {_wide(_a)} + {_wide(1)}) % {_wide(1 << _bits)})"
    _add_generator(_name, _steps_sql({"x": _next}, {"x": SEED % (1 << _bits)}, f"{_next} * {_wide(1 << (64 - _bits))}"))
for _name, _a, _bits, _first in (
    ("mwc_128_64_0xff96d28c3f3329da", 0xFF96D28C3F3329DA, 64, [SEED]), ("mwc_128_64_0xffebb71d94fcdaf9", 0xFFEBB71D94FCDAF9, 64, [SEED]),
    ("mwc_192_64_0xffa04e67b3c95d86", 0xFFA04E67B3C95D86, 64, [SEED] * 2), ("mwc_256_64_0xfff62cf2ccc0cdaf", 0xFFF62CF2CCC0CDAF, 64, [SEED] * 3),
    ("mwc_128_32_0xfffea2df", 0xFFFEA2DF, 32, [SEED & 0xFFFFFFFF, SEED >> 32, 0]),
):
    _t = f"(w0 * {_wide(_a)} + c)"
    _cols = {f"w{i}": f"w{i + 1}" for i in range(len(_first) - 1)} | {f"w{len(_first) - 1}": f"{_t} % {_wide(1 << _bits)}", "c": f"{_t} // {_wide(1 << _bits)}"}
    _add_generator(_name, _steps_sql(_cols, {f"w{i}": w for i, w in enumerate(_first)} | {"c": 1}, f"w{len(_first) - 1} * {_wide(1 << (64 - _bits))}"))
_K = f"{_wide(ROMU64)} % {_wide(M64)}"
_add_generator("romuduo", _steps_sql(
    {"x": f"y * {_K}", "y": _minus_sql(f"({_rot_sql('y', 36)} + {_rot_sql('y', 15)}) % {_wide(M64)}", "x")}, {"x": SEED, "y": SEED}, "x"))
_add_generator("romuduojr", _steps_sql({"x": f"y * {_K}", "y": _rot_sql(_minus_sql("y", "x"), 27)}, {"x": SEED, "y": SEED}, "x"))
_add_generator("romutrio", _steps_sql(
    {"x": f"z * {_K}", "y": _rot_sql(_minus_sql("y", "x"), 12), "z": _rot_sql(_minus_sql("z", "y"), 44)}, {"x": SEED, "y": 1, "z": 1}, "x"))
_add_generator("romutrio32", _steps_sql(
    {"x": f"z * {_wide(ROMU32)} % {_wide(1 << 32)}", "y": _rot_sql(_minus_sql("y", "x", 32), 6, 32), "z": _rot_sql(_minus_sql("z", "y", 32), 22, 32)},
    {"x": SEED & 0xFFFFFFFF, "y": SEED >> 32, "z": 0}, f"x * {_wide(1 << 32)}"))


def _middle_square_sql() -> str:
    """Five rounds of square, add and rotate, one derived table a round."""
    source = f"(SELECT n, {_mul(_state(1, 1), PHI)} AS y FROM (SELECT range AS n FROM range({DRAWS})))"
    source = f"(SELECT n, y, {_mod(f'{_wide('y')} + {_wide(PHI)}')} AS z, y AS v FROM {source})"
    square = lambda plus: _mod(f"{_wide('v')} * {_wide('v')} % {_wide(M64)} + {_wide(plus)}")
    for plus in ("y", "z", "y"):
        source = f"(SELECT n, y, z, CAST({_rot_sql(_wide('q'), 32)} AS UBIGINT) AS v FROM (SELECT *, {square(plus)} AS q FROM {source}))"
    source = f"(SELECT n, y, q, CAST({_rot_sql(_wide('q'), 32)} AS UBIGINT) AS v FROM (SELECT *, {square('z')} AS q FROM {source}))"
    return f"SELECT {_SHOWN} FROM (SELECT n, xor(q, {square('y')} >> 32) AS value FROM {source})"


_add_generator("MSWS-CTR", _middle_square_sql())

for _kind, _generator in (
    ("lcg", "lcg_64_64_0xa5b9ee81534fa94d"), ("mwc", "mwc_128_64_0xff96d28c3f3329da"), ("mwc192", "mwc_192_64_0xffa04e67b3c95d86"),
    ("mwc32", "mwc_128_32_0xfffea2df"), ("romuduo", "romuduo"), ("romutrio32", "romutrio32"),
):
    _add_stepped(_kind, _generator)
