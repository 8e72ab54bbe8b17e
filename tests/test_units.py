"""Generators, statistics, specifications, sources, streaming, and the command line, piece by piece."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spacelab import cli
from spacelab.functions.bits import ArrayOps, ColumnOps, IntOps, biased, multiply, signed, wrapping
from spacelab.functions.stats import (
    PValue, expected_collisions, format_p_value, headroom, p_value, poisson_tails, superscript, test_mean)
from spacelab.operators.cells import CellCodec, points
from spacelab.operators.collisions import pass_counts
from spacelab.plans.queries import ORACLE, QUERIES
from spacelab.plans.runner import execute, header, report
from spacelab.plans.spec import Grid, Run, SpecError, most_birthday_points, parse_u64
from spacelab.sources.generators import Generator, UnknownGenerator, generator, generator_names, register_generator
from spacelab.sources.orbit import LANE, orbit
from spacelab.sources.table import table_draws
from spacelab.streaming.progress import progress_writer

SEED = 0x0123456789ABCDEF
# name: outputs 0, 1, 2 and 1000 from SEED
VECTORS = {
    "mwc_128_64_0xff96d28c3f3329da": (0x0123456789ABCDEF, 0xE09510D397E5A487, 0xDEF483507C1A529A, 0xD367DE5D31BA05C0),
    "mwc_128_64_0xffebb71d94fcdaf9": (0x0123456789ABCDEF, 0xD5FCB23118BCD378, 0x8E028FDE9650C684, 0x96D613251D61BD03),
    "mwc_192_64_0xffa04e67b3c95d86": (0x0123456789ABCDEF, 0xCF79D74147649E1B, 0xD09CAFC7FF5FD2D9, 0xD31AB7F2522AAC98),
    "mwc_256_64_0xfff62cf2ccc0cdaf": (0x0123456789ABCDEF, 0x358443E8979A2962, 0x36A77E228F68F4D0, 0x6BB7B0D187969EAB),
    "mwc_128_32_0xfffea2df": (0x0000000000000000, 0x091BA13200000000, 0x4E81B4E700000000, 0x0FBEE61B00000000),
    "splitmix": (0xB2C058E4EBB5112C, 0x157A3807A48FAA9D, 0xD573529B34A1D093, 0x176694CC0CB5D669),
    "incr": (0x0123456789ABCDF0, 0x0123456789ABCDF1, 0x0123456789ABCDF2, 0x0123456789ABD1D8),
    "wyrand": (0xB455B6E67FEF10B0, 0x58B962217AAFC627, 0xD7488E0F880DBD37, 0x97225DA3A849E0F6),
    "wyrand-next": (0x49F219108CA4C0C1, 0x76E4BE579CCA29EF, 0xFA87AECFDA740306, 0xC3B23AE3030E92E6),
    "wyrand-v4": (0x368D5C952174CC4D, 0x09014CED49DD0226, 0x385A54D9BE575D3F, 0x1AEB9231A612D858),
    "wyrand128": (0xEBEFAC339896A947, 0x0DAFDB80DC2122A7, 0x9C3A92A8CBB3ECE2, 0x1667C78718E71C59),
    "romuduo": (0x0123456789ABCDEF, 0xB038422C9C458E05, 0xF6B53360E752809E, 0x312DB96694FDB17C),
    "romuduojr": (0x0123456789ABCDEF, 0xB038422C9C458E05, 0x0000000000000000, 0x37F33BD20F62AD01),
    "romutrio": (0x0123456789ABCDEF, 0xD3833E804F4C574B, 0x0000000000000000, 0x98EA622E93612646),
    "romutrio32": (0x89ABCDEF00000000, 0x0000000000000000, 0xAE5D46BA00000000, 0x7BA51A0200000000),
    "lcg_32_32_0xec65035": (0x89C6527C00000000, 0x13BDD3AD00000000, 0x9640E2D200000000, 0x1212A6D400000000),
    "lcg_32_32_0x915f77f5": (0x68D72EBC00000000, 0x306D1DED00000000, 0x6949CED200000000, 0x4E8F001400000000),
    "lcg_64_64_0xa5b9ee81534fa94d": (0x92C1613EDD60B7E4, 0x82000E691AD8D395, 0xB54F71EDD0E000D2, 0xDDB8B53283C1A35C),
    "MSWS-CTR": (0x6831769AB0AEDEF5, 0xD34A7D75631AB90F, 0x50AFF1C40EF4189C, 0x945F7A703D143D9A),
}


def test_all_generators_are_there():
    assert set(VECTORS) == set(generator_names()) - {"test-halves"}
    for name in ("wayrand", "nothing"):
        with pytest.raises(UnknownGenerator):
            generator(name)


@pytest.mark.parametrize("name", VECTORS)
def test_generator(name):
    g, out = generator(name), generator(name).outputs(SEED, 1001)
    assert (*out[:3], out[1000]) == VECTORS[name]
    if g.jump:
        for n in (0, 1, 2, 7, 1000):
            assert g.outputs(SEED, 1, n) == out[n : n + 1]
        assert g.at(SEED, 100_000) == g.jump(g.at(SEED, 99_000), 1000)
        far = (1 << 40) + (1 << 41) + 12345
        assert g.at(SEED, far) == g.jump(g.at(SEED, 1 << 40), far - (1 << 40))
    if g.block:
        for first, count in ((0, 40), (5, 1), (700, 33), (3, 0)):
            assert g.block(SEED, first, count).tolist() == out[first : first + count]
        assert int(g.block(SEED, 10**12, 1)[0]) == g.outputs(SEED, 1, 10**12)[0]
    if g.lanes:
        states = np.array([g.pack(g.at(SEED, k)) for k in (0, 3, 700)], np.uint64)
        got = np.array([g.lanes(states) for _ in range(50)])
        assert all(got[:, i].tolist() == out[k : k + 50] for i, k in enumerate((0, 3, 700)))
    for seed in (0, 1, 2**64 - 1):
        assert len(set(g.outputs(seed, 8))) > 1 or name.startswith(("romu", "mwc"))


@pytest.mark.parametrize("name", VECTORS)
def test_orbit_is_the_generator(spark, name):
    g, t, first, n = generator(name), 3, 5, LANE + 40
    rows = orbit(spark, name, SEED, n, t, first).orderBy("sample_id").collect()
    want = g.outputs(SEED, n * t, first * t)
    assert [r["sample_id"] for r in rows] == list(range(first, first + n))
    assert [r[f"draw_{i}"] % 2**64 for r in rows for i in range(t)] == want
    assert orbit(spark, name, SEED, 0, 1).count() == 0


def test_closed_forms_run_without_python(spark):
    for name in generator_names():
        plan = orbit(spark, name, 1, 100, 2)._jdf.queryExecution().executedPlan().toString()
        assert ("MapInArrow" in plan) == (generator(name).column is None)


def test_registering_a_generator(spark):
    halves = Generator("test-halves", lambda seed: (seed,), lambda s: (s[0], (s[0] >> 1 | 1 << 63,)), lanes=None, jump=None,
                       column=lambda o, seed, n: o.const(seed))
    register_generator(halves)
    assert generator("test-halves").outputs(4, 2) == [4, 1 << 63 | 2]
    assert orbit(spark, "test-halves", 9, 3, 1).select("draw_0").distinct().collect()[0][0] == 9


def test_array_arithmetic():
    values = [0, 1, 2, 3, 2**31, 2**32 - 1, 2**32, 2**63 - 1, 2**63, 2**64 - 2, 2**64 - 1, 0x9E3779B97F4A7C15]
    a, b = (np.array(x, np.uint64) for x in zip(*((x, y) for x in values for y in values)))
    ints, arrays = IntOps(), ArrayOps()
    for name in ("add", "mul", "xor", "mulhi", "less"):
        got = getattr(arrays, name)(a, b).tolist()
        assert got == [getattr(ints, name)(x, y) for x, y in zip(a.tolist(), b.tolist())], name
    assert arrays.rotl(a, 17).tolist() == [ints.rotl(x, 17) for x in a.tolist()] and arrays.shr(a, 9).tolist() == [x >> 9 for x in a.tolist()]
    assert multiply(a, b)[1].tolist() == [x * y % 2**64 for x, y in zip(a.tolist(), b.tolist())]


def test_column_arithmetic(spark):
    values = [0, 1, 2, 3, 2**31, 2**32 - 1, 2**32, 2**63 - 1, 2**63, 2**64 - 2, 2**64 - 1, 0x9E3779B97F4A7C15]
    pairs = [(signed(a), signed(b)) for a in values for b in values]
    ints = IntOps()
    with wrapping(spark):
        o = ColumnOps(spark.createDataFrame(pairs, "a long, b long"))
        a, b = F.col("a"), F.col("b")
        made = {"add": o.let(o.add(a, b)), "mul": o.let(o.mul(a, b)), "mulhi": o.let(o.mulhi(a, b)), "xor": o.let(o.xor(a, b)), "less": o.let(o.less(a, b)),
                "rotl": o.let(o.rotl(a, 17)), "shr": o.let(o.shr(a, 9))}
        rows = o.df.select("a", "b", *(c.alias(k) for k, c in made.items())).collect()
    for r in rows:
        x, y = r["a"] % 2**64, r["b"] % 2**64
        for k in made:
            want = getattr(ints, k)(x, 17 if k == "rotl" else 9) if k in ("rotl", "shr") else getattr(ints, k)(x, y)
            assert r[k] % 2**64 == want, (k, x, y)
    ordered = spark.createDataFrame([(signed(v),) for v in values], "a long").orderBy(biased(F.col("a"))).collect()
    assert [r["a"] % 2**64 for r in ordered] == sorted(values)


# ----- statistics -----


def test_means():
    assert expected_collisions(32e9, 2**64) == pytest.approx(27.755575598712134, rel=4e-16)
    assert expected_collisions(8e9, 2**64) == pytest.approx(1.7347234755091947, rel=4e-16)
    assert expected_collisions(7999985821, 2**64 / 16) == pytest.approx(27.7554771, rel=1e-6)
    assert expected_collisions(8e9, 2.0**60) == pytest.approx(27.755575547961804, rel=4e-16)
    assert expected_collisions(64e9, 2**64) == pytest.approx(111.0223023323856, rel=4e-16)
    assert test_mean(128_000_000_000, 2**108, True) == 1.6155871338926322
    assert expected_collisions(24000, 65536) == pytest.approx(3903.6866499278985, rel=1e-14)
    assert expected_collisions(0, 10) == expected_collisions(1, 10) == 0


def test_means_of_few_and_of_many_cells():
    from decimal import Decimal, getcontext

    getcontext().prec = 80
    for points, cells in ((2, 2), (10, 5), (1000, 7), (5, 49), (5, 51), (100, 50), (10**6, 10**6), (10**9, 10**3), (65536, 2**17), (32 * 10**9, 2**64)):
        p, c = Decimal(points), Decimal(cells)
        want = p - c + c * ((1 - 1 / c).ln() * p).exp()
        assert expected_collisions(points, cells) == pytest.approx(float(want), rel=1e-14)
    assert expected_collisions(5, 1) == 4


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from spacelab.sources.storage import NoSharedFolder, shared_folder

    held = {"dir": None}
    context = lambda master: SimpleNamespace(master=master, getCheckpointDir=lambda: held["dir"], setCheckpointDir=lambda d: held.update(dir=d))
    session = lambda master, conf=None: SimpleNamespace(sparkContext=context(master), conf=SimpleNamespace(get=lambda k, d: conf or d))
    for master in ("spark://h:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(NoSharedFolder):
            shared_folder(session(master))
    assert shared_folder(session("yarn", "/shared")) == "/shared"
    held["dir"] = None
    assert shared_folder(session("local[2]")).startswith("/")


def test_p_values():
    assert p_value(222, 111.0223023323856).number == pytest.approx(1.2959913978087028e-20, rel=1e-11)
    assert p_value(16, 111.0223023323856).eps == pytest.approx(1.804698905648335e-29, rel=1e-11)
    assert p_value(0, 27.755575598712134).eps == pytest.approx(8.828901577425957e-13, rel=1e-11)
    assert p_value(65, 1.6155871338926322).value == pytest.approx(8.595346190145383e-79, rel=1e-11)
    assert p_value(5, 5.0) == PValue("direct", 0.5) or 0 < p_value(5, 5.0).value < 1
    for bad in ((-1, 2.0), (1.5, 2.0), (1, math.nan), (1, -1.0), (math.inf, 2.0)):
        assert poisson_tails(*bad) is None and math.isnan(p_value(*bad).value)


@pytest.mark.parametrize("mean", [0.3, 1.0, 7.5, 40.0, 333.3])
def test_tails_are_sums_of_probabilities(mean):
    pmf = [math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(2000)]
    for count in (0, 1, 2, 5, 10, 40, 60, 300, 400):
        got = poisson_tails(count, mean)
        assert got.left == pytest.approx(math.fsum(pmf[: count + 1]), rel=1e-9)
        assert got.right == pytest.approx(1 if count == 0 else math.fsum(pmf[count:]), rel=1e-7, abs=1e-300)


def test_formats():
    assert format_p_value(p_value(0, 750)) == format_p_value(p_value(0, 750), True) == "1 − 1e-307"
    assert format_p_value(p_value(0, 700), True).startswith("1 − ") and format_p_value(p_value(0, 700), True) != format_p_value(p_value(0, 600), True)
    assert format_p_value(p_value(0, 40)) == "1" and format_p_value(p_value(0, 3), True) == repr(1 - math.exp(-3.0))
    assert [format_p_value(PValue("direct", x)) for x in (0.0, 1.0, 0.25, 1e-5, 1e-20, math.nan)] == ["0", "1", "0.25", "1e-5", "1e-20", "NaN"]
    assert format_p_value(PValue("near_one", 1e-5)) == "0.99999"
    assert (superscript(64), superscript(1234567890), superscript(-5)) == ("⁶⁴", "¹²³⁴⁵⁶⁷⁸⁹⁰", "⁻⁵")


def test_headroom():
    assert headroom(1000, 0) == 1000 and headroom(1000, 3) == 1000
    segment = 32_000_000_000 // 20
    assert round(20 * headroom(segment, 2) * 8 / 2**30, 3) == 59.807


# ----- specifications -----


@pytest.mark.parametrize("text, value", [("0", 0), ("12_345", 12345), ("0xDEAD_beef", 0xDEADBEEF), ("0o17", 15), ("0B101", 5), (" 7 ", 7), ("18446744073709551615", 2**64 - 1)])
def test_parse(text, value):
    assert parse_u64(text) == value


@pytest.mark.parametrize("text", ["", "0x", "_", "-1", "1.5", "0b2", "18446744073709551616", "12g"])
def test_parse_refuses(text):
    with pytest.raises(SpecError):
        parse_u64(text)


@pytest.mark.parametrize("make", [
    lambda: Grid(0, 1), lambda: Grid(1, 0), lambda: Grid(65, 1), lambda: Grid(10, 1, 60), lambda: Grid(8, 1, 64), lambda: Grid(8, 1, 0, 8), lambda: Grid(64, 3),
    lambda: Run(Grid(8, 1, d=1)), lambda: Run(Grid(8, 1), b=9), lambda: Run(Grid(64, 2), b=64), lambda: Run(Grid(8, 1), only=0), lambda: Run(Grid(8, 1), b=2, only=4),
    lambda: Run(Grid(8, 2, d=1), m=9, checkpoints=True, birthday=True), lambda: Run(Grid(8, 2), m=9, checkpoints=True), lambda: Run(Grid(8, 2, d=1), m=9, b=1, checkpoints=True),
    lambda: Run(Grid(8, 1), reps=0), lambda: Run(Grid(60, 1, d=59), m=100).samples])
def test_specs_refuse(make):
    with pytest.raises(SpecError):
        make()


def test_sizes():
    assert Run(Grid(16, 2), b=3).points == 2**32
    assert Run(Grid(36, 3), m=2_000_000_000, b=6, birthday=True).points == 128_000_000_000
    assert most_birthday_points(Grid(36, 3), 1) == int((2.0**108) ** (5 / 12) / 2 ** (1 / 3))
    with pytest.raises(SpecError, match="in only"):
        Run(Grid(4, 2), m=10**6).check_size()
    with pytest.raises(SpecError, match="too few"):
        Run(Grid(20, 2), m=100).check_size()
    with pytest.raises(SpecError, match="too many for"):
        Run(Grid(20, 2), m=10**6, birthday=True).check_size()


# ----- cells -----


@pytest.mark.parametrize("grid", [Grid(16, 2), Grid(63, 1), Grid(64, 1), Grid(13, 5), Grid(64, 2), Grid(22, 3), Grid(11, 3, 2, 1), Grid(32, 4, 7, 3), Grid(1, 64), Grid(40, 3, 24)])
def test_cells_of_every_width(spark, grid):
    draws = [generator("splitmix").outputs(k, grid.t) for k in range(300)]
    if grid.d:  # low bits to zero, so that some are kept
        clear = ((1 << grid.d) - 1) << (64 - grid.u - grid.s)
        draws[:150] = [[x & ~clear for x in row] for row in draws[:150]]
    df = spark.createDataFrame([tuple(signed(x) for x in row) for row in draws], ", ".join(f"draw_{i} long" for i in range(grid.t)))
    codec, want = CellCodec(grid.width), []
    for row in draws:
        es = [(x >> (64 - grid.u - grid.s)) & ((1 << grid.u) - 1) for x in row]
        if all(e & ((1 << grid.d) - 1) == 0 for e in es):
            cell = 0
            for e in es:
                cell = cell << (grid.u - grid.d) | e >> grid.d
            want.append(cell)
    value = lambda r: r[0] % 2**64 if len(codec.columns) == 1 else (r[0] % 2**64) << 64 | r[1] % 2**64
    kept = points(df, grid)
    assert [value(r) for r in kept.orderBy(*codec.order()).select(*codec.columns).collect()] == sorted(want)
    for b in (1, 5, min(grid.width, 63)):
        rows = kept.select(*codec.columns, codec.top(b).alias("top"), codec.low_bits(min(b, 62)).alias("low")).collect()
        assert all(r["top"] == value(r) >> (grid.width - b) and r["low"] == value(r) & ((1 << min(b, 62)) - 1) for r in rows)


def test_table_source(spark):
    df = spark.createDataFrame([(1, 5, "x"), (2, 5, "y"), (3, None, "z"), (4, 261, None)], "id int, key long, draw_0 string")
    got = points(table_draws(df, ["key"], order="id"), Grid(8, 1, 56)).orderBy("sample_id").collect()
    assert [(r["sample_id"], r["cell"]) for r in got] == [(1, 5), (2, 5), (4, 5)]
    mixed = table_draws(df, ["key"], mixed=True).collect()
    assert [r["draw_0"] % 2**64 for r in mixed] == [generator("splitmix").outputs(0, 1, k)[0] for k in (5, 5, 261)]
    assert table_draws(df.limit(0), ["key"]).count() == 0


# ----- reports, streaming, command line -----


def test_result_frames_and_report(spark):
    run = Run(Grid(8, 2), m=4000, b=1, reps=2, seed=1, pretty=True)
    got = execute(spark, run)
    units = got.units_frame(spark).collect()
    assert len(units) == 4 and units[1]["cum_points"] == 8000 == got.reps_frame(spark).collect()[0]["points"]
    assert sum(u["collisions"] for u in units) == got.collisions
    assert header(run)[0] == "Generator: SplitMix" and sum(x.startswith("Pass") for x in report(got)) == 4
    assert got.line().split("\t")[0] == str(got.collisions)


def test_stream_agrees_with_batch(spark, tmp_path):
    grid, source = Grid(9, 2), tmp_path / "in"
    draws = orbit(spark, "splitmix", 3, 6000, 2)
    draws.repartition(3).write.parquet(str(source))
    stream = spark.readStream.schema(draws.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = progress_writer(stream, grid, str(tmp_path / "out"), 2).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    done = spark.read.parquet(str(tmp_path / "out" / "batch-*"))
    last = done.where(F.col("batch") == done.agg(F.max("batch")).first()[0])
    want = pass_counts(points(draws, grid).withColumn("rep", F.lit(1)), CellCodec(18), 2)
    rows = lambda df: {tuple(r) for r in df.select("pass", "points", "collisions").collect()}
    assert rows(last) == rows(want) and done.select("batch").distinct().count() == 3


def test_command_line(spark, capsys):
    assert cli.main(["16", "2", "65536", "-b", "2", "-S", "0xABCD_1234_5678_9ABC"], spark) == 0
    out = capsys.readouterr()
    assert out.out == f"8\tp={format_p_value(p_value(8, 7.999806726351289))}\n" and out.err.count("Pass ") == 4
    assert cli.main("20 2 10000 -B -b 2 --pass 1 -S 0x0B174DA900000002".split(), spark) == 0
    assert capsys.readouterr().out == f"5\tlambda={14.551915228366852 / 4!r}\n"
    assert cli.main("20 1 10000 -s 44 -b 2 -g incr --strict".split(), spark) == 1
    for bad in (["0", "1"], ["16", "2", "100"], ["16", "2", "99999", "-g", "wayrand"], ["16", "2", "99999", "-b", "0"], ["16", "2", "-d", "2"], ["16", "2", "99999", "-S", "x"]):
        with pytest.raises(SystemExit) as e:
            cli.parse(bad)
        assert e.value.code == 2


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE) and len(QUERIES) > 30
