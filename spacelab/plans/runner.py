"""Runs tests: builds the plan, collects its few rows, and adds means and p-values."""

from __future__ import annotations

import sys
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import expected_collisions, format_p_value, headroom, p_value, superscript, test_mean
from ..operators.cells import CellCodec, points
from ..operators.collisions import checkpoint_counts, pass_counts
from ..operators.packed import MOST_IN_INTERVAL, Source, interval_borders, packed_class_counts, packed_interval_bits, packed_pass_counts
from ..operators.spacings import class_counts, interval_bits, spacings
from ..sources.generators import generator
from ..sources.orbit import orbit
from ..sources.storage import stored
from .spec import Run, SpecError

MOST_UNITS = 1 << 20  # units that the driver lists

UNITS = T.StructType([
    T.StructField("rep", T.IntegerType()), T.StructField("unit", T.LongType()), T.StructField("points", T.LongType()),
    T.StructField("collisions", T.LongType()), T.StructField("mean", T.DoubleType()), T.StructField("p_kind", T.StringType()),
    T.StructField("p_value", T.DoubleType()), T.StructField("p_eps", T.DoubleType()), T.StructField("cum_points", T.LongType()),
    T.StructField("cum_collisions", T.LongType()), T.StructField("cum_mean", T.DoubleType()), T.StructField("cum_p_value", T.DoubleType()),
    T.StructField("cum_p_eps", T.DoubleType())])


class NonUniformGenerator(RuntimeError):
    """A bin got more than its headroom, which a uniform generator does with probability below 10^-1000."""


@dataclass(frozen=True)
class Unit:
    """One value interval, spacing class, checkpoint or whole repetition, with what has added up so far."""

    rep: int
    unit: int
    points: int
    collisions: int
    mean: float
    cum_points: int
    cum_collisions: int
    cum_mean: float

    def row(self) -> tuple:
        p, c = p_value(self.collisions, self.mean), p_value(self.cum_collisions, self.cum_mean)
        return (self.rep, self.unit, self.points, self.collisions, self.mean, p.kind, p.value, p.eps, self.cum_points, self.cum_collisions,
                self.cum_mean, c.value, c.eps)


@dataclass
class Result:
    run: Run
    units: list[Unit] = field(default_factory=list)
    reps: list[Unit] = field(default_factory=list)
    alarms: list[str] = field(default_factory=list)
    seconds: float = 0.0

    @property
    def collisions(self) -> int:
        return sum(r.collisions for r in self.reps)

    @property
    def mean(self) -> float:
        return sum(r.mean for r in self.reps)

    @property
    def points(self) -> int:
        return sum(r.points for r in self.reps)

    def line(self) -> str:
        """The result: count and p-value, or for a single unit count and its share of the mean."""
        if self.run.only is not None:
            share = self.run.reps * self.run.mean / (1 << self.run.b)
            return f"{self.collisions}\tlambda={share!r}"
        return f"{self.collisions}\tp={format_p_value(p_value(self.collisions, self.mean), self.run.pretty)}"

    def units_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([u.row() for u in self.units], UNITS)

    def reps_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([u.row() for u in self.reps], UNITS)


def run_points(spark: SparkSession, run: Run) -> DataFrame:
    """The kept points of all repetitions, which continue one orbit: rep, sample_id, cell words."""
    draws = orbit(spark, run.generator, run.seed, run.samples * run.reps, run.grid.t)
    rep = (F.expr(f"sample_id DIV {run.samples}L") + 1).cast("int") if run.reps > 1 else F.lit(1)
    return points(draws, run.grid).withColumn("rep", rep)


def execute(spark: SparkSession, run: Run, source: DataFrame | None = None) -> Result:
    """Run a test.  ``source``: draws from elsewhere (sample_id, draw_0 ..) instead of the generator's orbit."""
    began = time.perf_counter()
    if run.only is None and run.b and run.reps << run.b > MOST_UNITS:
        raise SpecError(f"{run.reps} x 2^{run.b} units are more than the {MOST_UNITS} that are listed; run single units")
    codec = CellCodec(run.grid.width)
    rows = points(source, run.grid).withColumn("rep", F.lit(1)) if source is not None else None
    made = Source(spark, run.grid, run.points * run.reps, rows, run if source is None else None)
    result = Result(run)
    work = _birthday if run.birthday else _checkpoints if run.checkpoints else _collisions
    # points as rows are made only where they are asked for: some generators walk their orbit for them
    work(lambda: rows if rows is not None else run_points(spark, run), made, codec, run, result)
    if run.strict and result.alarms:
        raise NonUniformGenerator("; ".join(result.alarms))
    result.seconds = time.perf_counter() - began
    return result


def _alarm(result: Result, what: str, load: int, cap: int) -> None:
    if load > cap:
        result.alarms.append(f"{what} has {load} elements, more than {cap}: the generator is grossly non-uniform")


def _add_rep(result: Result, rep: int, n: int, collisions: int, mean: float) -> None:
    last = result.reps[-1] if result.reps else None
    result.reps.append(Unit(
        rep, 0, n, collisions, mean, n + (last.cum_points if last else 0), collisions + (last.cum_collisions if last else 0),
        mean + (last.cum_mean if last else 0.0)))


def _units(run: Run) -> list[int | None]:
    """What is counted in one go: everything, a single unit, or with ``replay`` one unit after the other."""
    return list(range(1 << run.b)) if run.replay and run.b and run.only is None else [run.only]


def _collisions(kept: Callable[[], DataFrame], made: Source, codec: CellCodec, run: Run, result: Result) -> None:
    """Passes in value order; what has added up is compared with as many of the 2^b equal parts of the cells."""
    got = {}
    for only in _units(run):
        counted = packed_pass_counts(made, run.b, only) if codec.width <= 64 else pass_counts(kept(), codec, run.b, only)
        got |= {(r["rep"], r["pass"]): r for r in counted.collect()}  # MOST_UNITS rows at most
    cells = float(run.grid.cells)
    part = cells / 2.0**run.b
    cap = headroom(run.samples, run.grid.t * run.grid.d + run.b)
    for rep in range(1, run.reps + 1):
        n = c = 0
        for k in range(1 << run.b) if run.only is None else (run.only,):
            r = got.get((rep, k))
            own_n, own_c = (r["points"], r["collisions"]) if r else (0, 0)
            n, c = n + own_n, c + own_c
            done = k + 1 if run.only is None else 1
            result.units.append(Unit(rep, k, own_n, own_c, expected_collisions(own_n, part), n, c, expected_collisions(n, done * part)))
            _alarm(result, f"pass {k} of repetition {rep}", own_n, cap)
        _add_rep(result, rep, n, c, expected_collisions(n, cells))


def _checkpoints(kept: Callable[[], DataFrame], made: Source, codec: CellCodec, run: Run, result: Result) -> None:
    ends = run.stages()
    got = {(r["rep"], r["stage"]): r for r in checkpoint_counts(kept(), codec, run.samples, len(ends)).collect()}
    cells, bits = float(run.grid.cells), run.grid.t * run.grid.d
    for rep in range(1, run.reps + 1):
        n = c = 0
        for k in range(1, len(ends) + 1):
            r = got.get((rep, k))
            new_n, new_c = (r["points"], r["collisions"]) if r else (n, c)
            mean = expected_collisions(new_n, cells)
            _alarm(result, f"checkpoint {k} of repetition {rep}", new_n - n, max(1, headroom(-(-run.samples // len(ends)), bits)))
            n, c = new_n, new_c
            result.units.append(Unit(rep, k, n, c, mean, n, c, mean))
        _alarm(result, f"repetition {rep}", n, headroom(run.samples, bits))
        _add_rep(result, rep, n, c, expected_collisions(n, cells))


def _birthday(kept: Callable[[], DataFrame], made: Source, codec: CellCodec, run: Run, result: Result) -> None:
    """Spacing classes; a class's mean is its share of the nominal one, a repetition's depends on the points kept.

    The orbit is scanned once: its points are stored, as runs by value interval that carry their loads and borders, or
    beyond 64 bits as rows.
    """
    if codec.width <= 64:
        bits = packed_interval_bits(codec.width, run.points * run.reps, run.b)
        runs = stored(made.runs(bits, False), "uncompressed")
        borders = stored(interval_borders(runs))  # 2^16 rows a repetition at most
        told = min(run.b, bits)
        part = F.expr(f"CAST(shiftright(part, {bits - told}) AS BIGINT)")
        loaded = borders.groupBy("rep", part.alias("pass")).agg(F.sum("n").alias("n"))
        crowded = (borders.agg(F.max("n")).first()[0] or 0) > MOST_IN_INTERVAL
    else:
        told, crowded = min(run.b, 16), True
        rows = stored(kept())
        loaded = rows.groupBy("rep", codec.top(told).alias("pass")).agg(F.count("*").alias("n"))
    loads = {(r["rep"], r["pass"]): r["n"] for r in loaded.collect()}
    got = {}
    if crowded:
        found = stored(spacings(rows if codec.width > 64 else kept(), codec, interval_bits(codec, run.points * run.reps)))
    for only in _units(run):
        if crowded:
            counted = class_counts(found, codec.width, run.b, only)
        else:
            counted = packed_class_counts(made, runs, borders, run.b, only)
        got |= {(r["rep"], r["klass"]): r for r in counted.collect()}
    share = run.mean / 2.0**run.b
    decimated = run.grid.t * run.grid.d
    for (rep, k), load in sorted(loads.items()):
        _alarm(result, f"interval {k} of 2^{told} of repetition {rep}", load, headroom(run.samples, decimated + told))
    for rep in range(1, run.reps + 1):
        n, s, c = sum(x for (r, _), x in loads.items() if r == rep), 0, 0
        for done, k in enumerate(range(1 << run.b) if run.only is None else (run.only,), 1):
            r = got.get((rep, k))
            own_s, own_c = (r["spacings"], r["collisions"]) if r else (0, 0)
            s, c = s + own_s, c + own_c
            result.units.append(Unit(rep, k, own_s, own_c, share, s, c, done * share))
            _alarm(result, f"spacing class {k} of repetition {rep}", own_s, headroom(run.samples, decimated + run.b))
        _add_rep(result, rep, n, c, test_mean(n, run.grid.cells, True))


def header(run: Run) -> list[str]:
    """What a test is about to do."""
    g = run.grid
    kind = "Birthday-spacings test" if run.birthday else "Collision test"
    lines = [
        f"Generator: {generator(run.generator).title}",
        f"Seed: {run.seed:#018x}",
        f"{kind} of {run.points} points in {g.t} dimension{'s' * (g.t > 1)}: {g.u} bits of each draw" + (f" below its top {g.s}" if g.s else "")
        + f", 2{superscript(g.width)} cells of {g.storage} bits, expected count {run.mean!r}",
    ]
    if run.b:
        lines.append(f"Counted in {1 << run.b} {'spacing classes' if run.birthday else 'value intervals'} of about {run.points >> run.b}")
    if g.d:
        lines.append(f"Decimated by {g.d} bits a dimension: one of about 2{superscript(g.d * g.t)} samples is kept, {run.samples} are scanned")
    return lines


def report(result: Result) -> list[str]:
    """Lines on units and repetitions."""
    run, lines = result.run, []
    show = lambda count, mean: format_p_value(p_value(count, mean), run.pretty)
    what, of = ("Checkpoint", len(run.stages())) if run.checkpoints else ("Class" if run.birthday else "Pass", 1 << run.b)
    for r in result.reps:
        for u in result.units if of > 1 else ():
            if u.rep == r.rep:
                text = f"{what} {u.unit + (0 if run.checkpoints else 1)}/{of}: {u.points} {'spacings' if run.birthday else 'points'}, {u.collisions} collisions, p={show(u.collisions, u.mean)}"
                if run.only is None and not run.checkpoints:
                    text += f"; combined: {u.cum_points} {'spacings' if run.birthday else 'points'}, {u.cum_collisions} collisions, p={show(u.cum_collisions, u.cum_mean)}"
                lines.append(text)
        if run.only is None:
            text = f"{r.collisions}\tp={show(r.collisions, r.mean)}"
            lines.append(text + (f"\tcombined: {r.cum_collisions}\tp={show(r.cum_collisions, r.cum_mean)}" if run.reps > 1 else ""))
    if run.only is not None:
        lines.append(f"Unit {run.only} of {1 << run.b} alone; add up the counts and means of all units for a p-value")
    lines += [f"Warning: {a}" for a in result.alarms]
    lines.append(f"Test completed in {result.seconds:.2f} seconds")
    return lines


def print_to_stderr(lines: list[str]) -> None:
    for line in lines:
        print(line, file=sys.stderr, flush=True)
