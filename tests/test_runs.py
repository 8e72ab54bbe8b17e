"""Golden counts of whole runs, and the equivalences between ways of computing them."""

from dataclasses import replace

import pytest

from spacelab.operators.cells import CellCodec
from spacelab.operators.collisions import histogram
from spacelab.operators.spacings import class_counts, spacings
from spacelab.plans.runner import NonUniformGenerator, execute, run_points
from spacelab.plans.spec import Grid, Run, SpecError
from spacelab.sources.generators import generator


def brute(run: Run) -> list[list[int]]:
    """Kept cells of every repetition, one draw after the other."""
    g, grid = generator(run.generator), run.grid
    state, reps = g.start(run.seed), []
    for _ in range(run.reps):
        cells = []
        for _ in range(run.samples):
            cell, keep = 0, True
            for _ in range(grid.t):
                value, state = g.step(state)
                e = (value >> (64 - grid.u - grid.s)) & ((1 << grid.u) - 1)
                keep &= e & ((1 << grid.d) - 1) == 0
                cell = (cell << (grid.u - grid.d)) | (e >> grid.d)
            if keep:
                cells.append(cell)
        reps.append(cells)
    return reps


def equal_spacings(cells: list[int], space: int) -> list[int]:
    v = sorted(cells)
    if len(v) < 2:
        return []
    gaps = [b - a for a, b in zip(v, v[1:])]
    return gaps + ([space - v[-1] + v[0]] if v[0] != v[-1] else [])


# kind, seed, u, t, d, b, m, kept, count
GOLDEN = [
    ("collision", 2024, 8, 2, 0, 4, 1500, 24000, 4051),
    ("collision", 7, 10, 2, 2, 4, 1500, 24112, 4028),
    ("birthday", 12345, 8, 2, 0, 4, 250, 4000, 3897),
    ("birthday", 42, 16, 2, 0, 0, 50000, 50000, 6389),
    ("birthday", 7, 64, 2, 0, 2, 1000, 4000, 0),
    ("birthday", 99, 10, 2, 2, 4, 250, 4100, 4002),
    ("collision", 0xABCD123456789ABC, 16, 2, 0, 2, 65536, 262144, 8),
    ("birthday", 0x0BADF00DDEADBEEF, 30, 2, 0, 2, 65536, 262144, 0),
    ("collision", 0x00C0FFEE12345678, 12, 2, 0, 0, 262144, 262144, 2072),
    ("collision", 0x0DEC1A7E00000001, 14, 2, 2, 0, 16384, 16335, 3),
    ("birthday", 0x0B174DA900000001, 20, 2, 0, 0, 40000, 40000, 12),
    ("birthday", 3, 30, 2, 2, 0, 40000, 40196, 0),
    ("birthday", 0x0B174DA900000003, 16, 2, 0, 2, 12500, 50000, 6349),
    ("collision", 0x0D15EA5E0BADF00D, 12, 2, 0, 2, 16384, 65536, 130),
]


@pytest.mark.parametrize("kind, seed, u, t, d, b, m, kept, count", GOLDEN)
def test_golden(spark, kind, seed, u, t, d, b, m, kept, count):
    got = execute(spark, Run(Grid(u, t, d=d), m=m, b=b, birthday=kind == "birthday", seed=seed))
    assert (got.points, got.collisions) == (kept, count)
    assert sum(x.collisions for x in got.units) == count


def test_passes_of_a_collision_test(spark):
    run = Run(Grid(14, 2, d=2), m=4096, b=2, seed=0x0DEC1A7E00000002)
    got = execute(spark, run)
    assert [(u.points, u.collisions) for u in got.units] == [(4207, 2), (4055, 0), (4149, 3), (4110, 2)]
    assert got.mean == pytest.approx(8.13118715876467, rel=1e-14)
    ones = [execute(spark, Run(run.grid, m=4096, b=2, seed=run.seed, only=k)) for k in (0, 2)]
    assert [o.collisions for o in ones] == [2, 3]
    assert ones[0].line() == f"2\tlambda={run.mean / 4!r}"


def test_classes_of_a_birthday_test(spark):
    got = execute(spark, Run(Grid(20, 2), m=10000, b=2, birthday=True, seed=0x0B174DA900000002))
    assert [(u.points, u.collisions) for u in got.units] == [(9947, 6), (9971, 5), (10173, 5), (9909, 1)]
    assert got.collisions == 17 and got.mean == pytest.approx(14.551915228366852, rel=1e-14)


def test_checkpoints(spark):
    run = Run(Grid(10, 2, d=2), m=24000, checkpoints=True, seed=7)
    assert run.stages() == [96000, 192000, 288000, 384000]
    got = execute(spark, run)
    assert [(u.points, u.collisions) for u in got.units] == [(5990, 254), (11940, 1086), (18004, 2316), (24112, 4028)]


@pytest.mark.parametrize("seed, kept", [(0x0C0C0C0C00000001, 16187), (0x0C0C0C0C00000002, 16422)])
def test_checkpoints_of_a_sparse_run(spark, seed, kept):
    got = execute(spark, Run(Grid(16, 2, d=2), m=16384, checkpoints=True, seed=seed))
    assert len(got.units) == 4 and (got.points, got.collisions) == (kept, 0)


def test_breakdowns(spark):
    for run, want in (
        (Run(Grid(16, 2), m=65536, b=2, seed=0xABCD123456789ABC), [(65669, 2), (65330, 3), (65394, 2), (65751, 1)]),
        (Run(Grid(12, 2), m=16384, b=2, seed=0x0D15EA5E0BADF00D), [(16332, 38), (16318, 25), (16480, 36), (16406, 31)]),
        (Run(Grid(16, 2), m=12500, b=2, birthday=True, seed=0x0B174DA900000003), [(12443, 1623), (12607, 1611), (12493, 1569), (12457, 1546)]),
    ):
        assert [(u.points, u.collisions) for u in execute(spark, run).units] == want


def test_repetitions_continue_the_orbit(spark):
    got = execute(spark, Run(Grid(8, 2), m=4000, reps=3, seed=12345))
    assert [r.collisions for r in got.reps] == [125, 131, 125]
    assert got.reps[-1].cum_collisions == got.collisions == 381


@pytest.mark.parametrize("name, u, t, d, s", [
    ("wyrand128", 16, 2, 0, 0), ("lcg_32_32_0xec65035", 11, 3, 0, 0), ("lcg_64_64_0xa5b9ee81534fa94d", 21, 3, 0, 0), ("MSWS-CTR", 32, 2, 0, 0),
    ("mwc_192_64_0xffa04e67b3c95d86", 13, 5, 0, 0), ("romutrio32", 9, 2, 1, 0), ("wyrand-v4", 40, 2, 1, 5), ("wyrand-next", 6, 2, 0, 58),
    ("incr", 11, 1, 0, 53)])
def test_against_brute_force_at_every_width(spark, name, u, t, d, s):
    run = Run(Grid(u, t, s, d), generator=name, m=1500, b=1, seed=0x0123456789ABCDEF, reps=2)
    cells = brute(run)
    codec = CellCodec(run.grid.width)
    rows = run_points(spark, run).collect()
    for rep in (1, 2):
        got = sorted(
            (r[codec.columns[0]] % 2**64) if len(codec.columns) == 1 else (r["cell_hi"] % 2**64) << 64 | (r["cell_lo"] % 2**64)
            for r in rows if r["rep"] == rep)
        assert got == sorted(cells[rep - 1])
    assert execute(spark, run).collisions == sum(len(c) - len(set(c)) for c in cells)
    found = execute(spark, Run(run.grid, generator=name, m=1500, b=1, seed=run.seed, reps=2, birthday=True))
    gaps = [equal_spacings(c, run.grid.cells) for c in cells]
    assert found.collisions == sum(len(g) - len(set(g)) for g in gaps)
    for k in (0, 1):
        assert sum(x.points for x in found.units if x.unit == k) == sum(x % 2 == k for g in gaps for x in g)


def test_interval_bits_do_not_matter(spark):
    codec = CellCodec(16)
    kept = run_points(spark, Run(Grid(8, 2), m=3000, seed=5)).persist()
    want = {tuple(r) for r in class_counts(spacings(kept, codec, 0), 16, 2).collect()}
    for bits in (1, 5, 12, 16):
        assert {tuple(r) for r in class_counts(spacings(kept, codec, bits), 16, 2).collect()} == want
    assert sum(r["points"] for r in histogram(kept, codec, 3).collect()) == 3000


def test_spacings_wrap_and_equal_points(spark):
    codec = CellCodec(64)
    points = lambda values: spark.createDataFrame([(1, v - 2**64 if v >> 63 else v) for v in values], "rep int, cell long")
    for bits in (0, 4):
        got = sorted(r["spacing"] % 2**64 for r in spacings(points([3, 10, 2**64 - 1]), codec, bits).collect())
        assert got == [4, 7, 2**64 - 11]
        assert class_counts(spacings(points([7] * 4), codec, bits), 64).first()["collisions"] == 2
    assert spacings(points([7]), codec, 0).count() == 0
    assert spacings(points([7]).limit(0), codec, 2).count() == 0


@pytest.mark.parametrize("birthday", [False, True])
@pytest.mark.parametrize("grid", [Grid(16, 2), Grid(40, 2)])
def test_replay_counts_the_same(spark, birthday, grid):
    run = Run(grid, "incr", m=1000, b=2, birthday=birthday, reps=2, seed=5)
    assert execute(spark, replace(run, replay=True)).units == execute(spark, run).units


@pytest.mark.parametrize("birthday", [False, True])
def test_an_orbit_is_walked_once(spark, monkeypatch, birthday):
    from spacelab.sources import orbit

    walks = []
    keep = orbit.stored
    monkeypatch.setattr(orbit, "stored", lambda df: walks.append(1) or keep(df))
    execute(spark, Run(Grid(9, 2), "romuduo", m=1500, b=1, birthday=birthday))
    assert len(walks) == 1


def test_a_birthday_test_scans_its_points_once(spark, tmp_path):
    """What is counted reads the stored runs, never the orbit again."""
    from spacelab.operators.packed import Source, interval_borders, packed_class_counts
    from spacelab.sources.storage import stored

    run = Run(Grid(10, 2), m=4000, birthday=True)
    made = Source(spark, run.grid, run.points, run=run)
    runs = stored(made.runs(2, False), "uncompressed")
    plan = packed_class_counts(made, runs, interval_borders(runs))._jdf.queryExecution().optimizedPlan().toString()
    assert "Range (" not in plan and "parquet" in plan


def test_too_many_units_are_refused(spark):
    with pytest.raises(SpecError):
        execute(spark, Run(Grid(32, 2), m=1, b=40))
    assert execute(spark, Run(Grid(32, 2), m=1, b=10, only=3, birthday=True)).run.only == 3


def test_alarm(spark):
    run = Run(Grid(20, 1, 44), generator="incr", m=8192, b=2, seed=0)  # low bits of a counter: all in the first interval
    got = execute(spark, run)
    assert got.alarms and got.points == 4 * 8192
    with pytest.raises(NonUniformGenerator):
        execute(spark, Run(run.grid, generator="incr", m=8192, b=2, strict=True))


def test_session_setting_is_restored(spark):
    for value in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", value)
        execute(spark, Run(Grid(8, 2), m=2000, birthday=True))
        assert spark.conf.get("spark.sql.ansi.enabled") == value
    spark.conf.set("spark.sql.ansi.enabled", "true")
