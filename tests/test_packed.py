"""The packed operators give what the row-wise ones give, for even and for degenerate points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spacelab.functions.bits import signed
from spacelab.operators import packed
from spacelab.operators.cells import CellCodec, points
from spacelab.operators.collisions import pass_counts
from spacelab.operators.packed import Source, cells_of, interval_borders, packed_class_counts, packed_pass_counts
from spacelab.operators.spacings import class_counts, spacings
from spacelab.plans.runner import execute
from spacelab.plans.spec import Grid, Run
from spacelab.sources.generators import generator
from spacelab.sources.orbit import orbit
from spacelab.sources.table import table_draws


def rows(df, names):
    return sorted(tuple(r) for r in df.select(*names).collect())


CASES = {
    "none": [], "one": [5], "equal": [7] * 500, "few": [0, 0, 1, 2**20 - 1, 2**20 - 1, 2**19], "hot": [3] * 2000 + list(range(1000)),
    "even": [int(x) for x in np.random.default_rng(9).integers(0, 2**20, 4000)], "low": list(range(64)) * 3, "gaps": [i * 1000 for i in range(900)],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("portion", [packed.PORTION, 100])
def test_packed_counts(spark, monkeypatch, name, portion):
    monkeypatch.setattr(packed, "PORTION", portion)
    grid, codec = Grid(20, 1, 44), CellCodec(20)
    kept = spark.createDataFrame([(1 + i % 2, x) for i, x in enumerate(CASES[name])], "rep int, cell long").repartition(3).persist()
    source = Source(spark, grid, 10_000, kept)
    names = ["rep", "pass", "points", "collisions"]
    for b, only in ((0, None), (3, None), (3, 5), (20, None)):
        assert rows(packed_pass_counts(source, b, only), names) == rows(pass_counts(kept, codec, b, only), names)
    names = ["rep", "klass", "spacings", "collisions"]
    for bits in (0, 4):
        runs = source.runs(bits, False)
        borders = interval_borders(runs)
        for b, only in ((0, None), (2, None), (2, 1)):
            want = class_counts(spacings(kept, codec, bits), 20, b, only)
            assert rows(packed_class_counts(source, runs, borders, b, only), names) == rows(want, names)


@pytest.mark.parametrize("width", [63, 64])
def test_packed_spacings_of_wide_cells(spark, width):
    values = [3, 10, 2**width - 1, 2 ** (width - 1), 2 ** (width - 1) - 7, 10]
    kept = spark.createDataFrame([(1, signed(v)) for v in values], "rep int, cell long")
    source, codec = Source(spark, Grid(width, 1, 0), 10, kept), CellCodec(width)
    for bits in (0, 3):
        runs = source.runs(bits, False)
        got = rows(packed_class_counts(source, runs, interval_borders(runs), 1), ["klass", "spacings", "collisions"])
        assert got == rows(class_counts(spacings(kept, codec, bits), width, 1), ["klass", "spacings", "collisions"])


@pytest.mark.parametrize("grid", [Grid(16, 2), Grid(64, 1), Grid(11, 3, 2, 1), Grid(7, 9), Grid(20, 1, 44), Grid(9, 4, 7, 3)])
def test_cells_of_arrays(spark, grid):
    draws = np.array(generator("wyrand").outputs(3, 400 * grid.t), np.uint64).reshape(400, grid.t)
    cell, stays = cells_of(draws, grid)
    cell = cell if stays is None else cell[stays]
    want = points(orbit(spark, "wyrand", 3, 400, grid.t), grid).orderBy("sample_id").collect()
    assert cell.tolist() == [r["cell"] % 2**64 for r in want]


@pytest.mark.parametrize("name", ["splitmix", "lcg_64_64_0xa5b9ee81534fa94d", "mwc_128_32_0xfffea2df", "romutrio"])
def test_runs_of_an_orbit_are_runs_of_its_rows(spark, name):
    for run in (Run(Grid(9, 2), name, m=3000, reps=2, b=2, seed=11), Run(Grid(9, 2, d=1), name, m=700, reps=2, seed=11)):
        direct = execute(spark, run)
        draws = orbit(spark, name, 11, run.samples, 2)
        first = execute(spark, Run(run.grid, name, m=run.m, b=run.b, seed=11), source=draws)
        assert [(u.points, u.collisions) for u in direct.units if u.rep == 1] == [(u.points, u.collisions) for u in first.units]


def test_table_source_in_a_run(spark):
    df = spark.range(3000).select((F.col("id") % 700).alias("k"))
    got = execute(spark, Run(Grid(10, 1, 54), m=750, b=2), source=table_draws(df, ["k"]))
    assert (got.points, got.collisions) == (3000, 2300)
    assert [u.points for u in got.units] == [sum(i % 700 // 256 == k for i in range(3000)) for k in range(4)]


@pytest.mark.parametrize("points, packed_form", [(packed.MOST_IN_INTERVAL, True), (packed.MOST_IN_INTERVAL + 1, False)])
def test_the_most_crowded_interval(spark, monkeypatch, points, packed_form):
    """A counter's points fill one interval: at the bound it is packed, beyond it goes through rows."""
    import spacelab.plans.runner as runner

    rows = []
    keep = runner.spacings
    monkeypatch.setattr(runner, "spacings", lambda *a: rows.append(1) or keep(*a))
    got = execute(spark, Run(Grid(40, 1, 24), "incr", m=points, birthday=True))
    assert (got.points, got.collisions) == (points, points - 2) and (not rows) == packed_form


def test_a_crowded_interval_goes_row_wise(spark, monkeypatch):
    import spacelab.plans.runner as runner

    run = Run(Grid(20, 1, 44), "incr", m=4096, birthday=True)
    want = execute(spark, run).collisions
    monkeypatch.setattr(runner, "MOST_IN_INTERVAL", 100)
    assert execute(spark, run).collisions == want == 4094
