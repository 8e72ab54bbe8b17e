"""Tests on tables: intervals taken from the data, ranks, sums so far, statistics as columns, pruning, loads, shares, streams."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spacelab.functions import columns, stats
from spacelab.operators import pruning
from spacelab.operators.cells import CellCodec, points
from spacelab.operators.collisions import checkpoint_counts, pass_counts
from spacelab.operators.prefix import gapless_rank, running_sums
from spacelab.operators.spacings import BORDER, class_counts, in_intervals, spacings
from spacelab.plans import tables
from spacelab.plans.queries import ORACLE, QUERIES
from spacelab.plans.spec import Grid, SpecError
from spacelab.sources.table import table_draws
from spacelab.streaming.progress import change_writer, latest

# ----- spacings of any distribution -----


def equal_gaps(cells, space, b=0):
    cells = sorted(cells)
    gaps = [y - x for x, y in zip(cells, cells[1:])] + ([space - cells[-1] + cells[0]] if cells[0] != cells[-1] else [])
    return {k: (sum(g % 2**b == k for g in gaps), sum(n - 1 for g, n in Counter(gaps).items() if g % 2**b == k)) for k in {g % 2**b for g in gaps}}


def kept(spark, cells, width, rep="int"):
    signed = lambda x: x - 2**64 if x >> 63 else x
    if width <= 64:
        return spark.createDataFrame([(1, signed(c)) for c in cells], f"rep {rep}, cell long")
    return spark.createDataFrame([(1, signed(c >> 64), signed(c % 2**64)) for c in cells], f"rep {rep}, cell_hi long, cell_lo long")


def shapes():
    pick = random.Random(2)
    low = [pick.randrange(3000) for _ in range(4000)]
    hot = [77] * 1500 + [pick.randrange(10**9) for _ in range(3000)]
    return {"low": low, "hot": hot, "one": [5] * 50, "ends": [0, 2**40 - 1] * 3 + low, "even": list(range(0, 9000, 3)), "alone": [9]}


@pytest.mark.parametrize("name", shapes())
@pytest.mark.parametrize("width", [40, 64, 100, 128])
def test_spacings_of_any_distribution(spark, name, width):
    cells = shapes()[name]
    if width > 64:
        cells = [c << 59 | c % 7 for c in cells]
    found = class_counts(spacings(kept(spark, cells, width).repartition(5), CellCodec(width), 3), width, 2)
    assert {r["klass"]: (r["spacings"], r["collisions"]) for r in found.collect()} == equal_gaps(cells, 2**width, 2)


@pytest.mark.parametrize("name", ["low", "hot", "even"])
def test_intervals_have_like_loads(spark, name):
    """No interval has over twice the mean of its distinct cells, though all values share their top bits."""
    cells = shapes()[name] + [10**6 + i * i for i in range(20_000)]
    borders = in_intervals(kept(spark, cells, 80).repartition(3), CellCodec(80), 3).where(F.col("kind") == BORDER).collect()
    loads = [r["n"] for r in borders]
    assert sum(loads) == len(set(cells)) and len(loads) == 8 and max(loads) <= 2 * sum(loads) / len(loads)


def test_spacings_of_repetitions_of_any_integral_type(spark):
    rows = [(r, c) for r in (2**40, -3) for c in (1, 4, 9, 9, 16 + r % 5)]
    found = class_counts(spacings(spark.createDataFrame(rows, "rep long, cell long"), CellCodec(20)), 20).collect()
    want = {r: equal_gaps([c for q, c in rows if q == r], 2**20)[0] for r in (2**40, -3)}
    assert {r["rep"]: (r["spacings"], r["collisions"]) for r in found} == want


# ----- ranks and sums so far -----


@pytest.mark.parametrize("rows", [[], [(None, "a")], [(i * 7919 % 1000, "x" * (i % 5)) for i in range(3000)], [(5, "same")] * 2000 + [(None, None), (1, None)]])
def test_gapless_rank(spark, rows):
    table = spark.createDataFrame(rows, "k int, _tie string").repartition(6)
    ranked, count = gapless_rank(table, ["k", F.col("_tie").desc_nulls_last()], "rank")
    got = [(r["rank"], r["k"], r["_tie"]) for r in ranked.orderBy("rank").collect()]
    assert ranked.columns == ["k", "_tie", "rank"] and count == len(rows) and [g[0] for g in got] == list(range(len(rows)))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1] is None, [-ord(c) for c in r[1] or ""] + [1])
    assert [g[1:] for g in got] == sorted(rows, key=order)


def test_rank_is_spread_over_tasks(spark, monkeypatch):
    """Equal rows, however many, lie in several ranges."""
    from spacelab.operators import prefix

    kept, keep = [], prefix.stored
    monkeypatch.setattr(prefix, "stored", lambda df: kept.append(keep(df)) or kept[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        gapless_rank(spark.range(20_000).select(F.lit(1).alias("k")), ["k"], "rank")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    loads = [r["count"] for r in kept[0].groupBy(F.shiftright("_at", 33)).count().collect()]
    assert len(loads) == 4 and max(loads) < 10_000


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_running_sums(spark, bits):
    pick = random.Random(bits)
    at = {r: sorted(pick.sample(range(5000), 300)) for r in ("a", "b", None)}
    rows = [(r, x, pick.randrange(9), None if pick.random() < 0.1 else 0.5) for r, xs in at.items() if r for x in xs]
    got = running_sums(spark.createDataFrame(rows, "g string, at long, v int, d double"), ["g"], "at", {"sv": "v", "sd": "d"}, bits, 13)
    want = {}
    for g in ("a", "b"):
        v = d = 0
        for r in sorted(r for r in rows if r[0] == g):
            v, d = v + r[2], d + (r[3] or 0)
            want[g, r[1]] = (v, d)
    assert {(r["g"], r["at"]): (r["sv"], r["sd"]) for r in got.collect()} == want
    assert running_sums(got.limit(0).select("g", "at", "v"), [], "at", {"s": "v"}).count() == 0


def test_many_stages(spark):
    pick = random.Random(8)
    rows = [(1 + j % 2, j, pick.randrange(40)) for j in range(500)]
    table = spark.createDataFrame(rows, "rep int, sample_id long, cell long")
    got = {(r["rep"], r["stage"]): (r["points"], r["collisions"]) for r in checkpoint_counts(table, CellCodec(10), 500, 100_000).collect()}
    assert len(got) == 200_000
    for rep, stage in [(1, 1), (1, 200), (2, 400), (1, 77_777), (2, 100_000), (2, 50_001)]:
        cells = [c for r, j, c in rows if r == rep and j < 500 * stage // 100_000]
        assert got[rep, stage] == (len(cells), len(cells) - len(set(cells)))


# ----- statistics as columns -----


def test_means_and_headroom_as_columns(spark):
    rows = [(n, float(c), b) for n in (0, 1, 2, 40, 1000, 10**6, 8 * 10**9, 10**13) for c in (1, 2, 49, 50, 2**20, 2**64, 2**128) for b in (0, 2, 7, 40)]
    table = spark.createDataFrame(rows, "n long, c double, b int")
    found = table.select("*", columns.expected_collisions_of("n", "c").alias("e"), columns.birthday_mean_of("n", "c").alias("m"), columns.headroom_of("n", "b").alias("h")).collect()
    for r in found:
        assert math.isclose(r["e"], stats.expected_collisions(r["n"], r["c"]), rel_tol=1e-12)
        assert math.isclose(r["m"], stats.test_mean(r["n"], r["c"], True), rel_tol=1e-12) and r["h"] == stats.headroom(r["n"], r["b"])


ANCHORS = [  # published runs: count, mean, kind, number
    (0, 27.755575598712134, "near_one", 8.828901577425957e-13), (0, stats.expected_collisions(7_999_985_821, 2.0**60), "near_one", 8.829770712901635e-13),
    (222, 111.0223023323856, "direct", 1.2959913978087028e-20), (16, 111.0223023323856, "near_one", 1.804698905648335e-29),
    (65, 1.6155871338926322, "direct", 8.595346190145383e-79)]


def test_p_values_as_columns(spark):
    odd = [(0, 750.0), (5, 0.0), (5, -1.0), (5, math.nan), (5, math.inf), (0, 1e-300), (3, 3.0), (10**6, 10**6 + 0.5), (10**6 + 9000, 1e6), (2, 1e-9), (7, 7.000001)]
    table = spark.createDataFrame([(float(c), m) for c, m in odd] + [(float(c), m) for c, m, *_ in ANCHORS] + [(None, 1.0), (1.0, None), (1.5, 2.0), (-1.0, 2.0)], "c double, m double")
    found = table.select("c", "m", columns.p_value_of("c", "m").alias("p")).collect()
    for r in found:
        want = stats.p_value(*(math.nan if x is None else x for x in (r["c"], r["m"])))
        assert r["p"]["kind"] == want.kind and (r["p"]["eps"] is None) == (want.eps is None), r
        got = r["p"]["value"] if want.kind == "direct" else r["p"]["eps"]
        assert (math.isnan(got) and math.isnan(want.number)) or math.isclose(got, want.number, rel_tol=1e-10, abs_tol=5e-324), (r, want)
    for r, (_, _, kind, number) in zip(found[len(odd):], ANCHORS):
        assert r["p"]["kind"] == kind and math.isclose(r["p"]["eps" if kind == "near_one" else "value"], number, rel_tol=1e-12)


def test_a_million_p_values(spark):
    found = spark.range(1 << 20).select(columns.p_value_of(F.col("id") % 97, 1 + F.col("id") % 89).alias("p"))
    r = found.agg(F.count("p.value").alias("n"), F.min("p.value").alias("low"), F.max("p.value").alias("high")).first()
    assert r["n"] == 1 << 20 and 0 < r["low"] < 1e-50 and r["high"] <= 1


def test_vectorised_tails():
    count, mean = np.array([0, 1, 5, 1000, 1100]), np.array([2.0, 2.0, 2.0, 1000.0, 1000.0])
    left, right = columns.poisson_tails_of(count, mean)
    for i in range(5):
        want = stats.poisson_tails(float(count[i]), mean[i])
        assert math.isclose(left[i], want.left, rel_tol=1e-12) and math.isclose(right[i], want.right, rel_tol=1e-12)
    assert columns.poisson_tails_of(np.zeros(0), np.zeros(0))[0].size == 0


# ----- repetitions and reports -----


def test_repetitions_of_a_table(spark):
    pick = random.Random(6)
    rows = [(pick.randrange(50), pick.randrange(10**6), pick.randrange(600)) for _ in range(1000)] + [(1, 1, None)]
    table = spark.createDataFrame(rows, "day int, key int, v long").repartition(4)
    draws, samples = tables.ordered_draws(table, ["v"], ["day", ("key", False)])
    assert samples == 1000
    cells = [v & 511 for _, _, v in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[0], -r[1]))]
    for reps in (1, 3, 7):
        parts, at = [], 0
        for i in range(reps):
            size = 1000 // reps + (i < 1000 % reps)
            parts.append(cells[at : at + size])
            at += size
        for birthday in (False, True):
            found = tables.repetition_report(tables.in_repetitions(points(draws, Grid(9, 1, 55)), samples, reps), CellCodec(9), birthday).orderBy("rep").collect()
            n = c = m = 0
            for r, own in zip(found, parts, strict=True):
                count = equal_gaps(own, 512)[0][1] if birthday else len(own) - len(set(own))
                mean = stats.test_mean(len(own), 512, birthday)
                n, c, m = n + len(own), c + count, m + mean
                assert (r["points"], r["collisions"], r["cum_points"], r["cum_collisions"]) == (len(own), count, n, c)
                assert math.isclose(r["mean"], mean, rel_tol=1e-12) and math.isclose(r["cum_mean"], m, rel_tol=1e-12)
                assert math.isclose(r["cum_p_value"], stats.p_value(c, m).value, rel_tol=1e-9)


def test_reports_of_passes_and_checkpoints(spark):
    table = spark.range(3000).select((F.col("id") * 7919 % 1013).alias("v"), "id")
    draws = table_draws(table, ["v"], "id")
    rows = points(draws, Grid(10, 1, 54)).withColumn("rep", F.lit(1))
    found = tables.pass_report(rows, CellCodec(10), 2).orderBy("pass").collect()
    assert [r["points"] for r in found] == [sum(i * 7919 % 1013 // 256 == k for i in range(3000)) for k in range(4)]
    assert found[-1]["cum_points"] == 3000 and math.isclose(found[-1]["cum_mean"], stats.expected_collisions(3000, 1024), rel_tol=1e-12)
    last = tables.checkpoint_report(rows, CellCodec(10), 3000, 5).where("stage = 5").first()
    assert (last["points"], last["collisions"]) == (3000, 3000 - 1013) and math.isclose(last["p_value"], stats.p_value(1987, last["mean"]).value, rel_tol=1e-9)
    counted = tables.counted_cells(rows, CellCodec(10))
    classes = tables.class_report(counted, spacings(counted, CellCodec(10), counted=True), CellCodec(10), 1).collect()
    assert sum(r["spacings"] for r in classes) == 3000


# ----- pruning -----


@pytest.mark.parametrize("grid, b", [(Grid(10, 1, 54), 3), (Grid(10, 2, 54), 4), (Grid(6, 2, 58, 2), 5), (Grid(64, 1), 4), (Grid(12, 1), 2), (Grid(20, 1, 44), 9)])
def test_pruned_passes_lose_nothing(spark, grid, b):
    pick = random.Random(b)
    values = [pick.choice([pick.randrange(1024), pick.randrange(-(2**63), 2**63), pick.randrange(2**20)]) for _ in range(2000)]
    table = spark.createDataFrame([(v, w) for v, w in zip(values, values[::-1])], "v long, w long")
    names = ["v", "w"][: grid.t]
    codec, rows = CellCodec(grid.width), lambda df: points(table_draws(df, names), grid).withColumn("rep", F.lit(1))
    for k in {0, 1, (1 << b) - 1}:
        want = pass_counts(rows(table), codec, b, k).collect()
        assert pass_counts(rows(pruning.in_pass(table, "v", grid, b, k)), codec, b, k).collect() == want
    with pytest.raises(SpecError):
        pruning.pass_range("v", grid, b, 1 << b)


def test_ranges_reach_the_scan(spark, tmp_path):
    table = spark.range(0, 1 << 16, 1, 8).withColumnRenamed("id", "v")
    table.write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    found = pruning.in_pass(read, "v", Grid(16, 1, 48), 3, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan and "GreaterThanOrEqual(v,16384)" in plan and found.count() == 1 << 13


def test_replay_reads_one_folder(spark, tmp_path):
    cells = points(table_draws(spark.range(5000).select((F.col("id") * 31 % 4099).alias("v")), ["v"]), Grid(13, 1, 51)).withColumn("rep", F.lit(1))
    there = pruning.by_pass(cells, CellCodec(13), 3, str(tmp_path / "cells"))
    total = []
    for k in range(8):
        one = there.where(F.col("pass") == k)
        assert f"PartitionFilters: [isnotnull(pass" in one._jdf.queryExecution().executedPlan().toString()
        assert len(one.inputFiles()) and all(f"pass={k}/" in f for f in one.select(F.input_file_name()).distinct().toPandas().iloc[:, 0])
        total += [tuple(r) for r in pass_counts(one.drop("pass"), CellCodec(13), 3).collect()]
    assert sorted(total) == sorted(tuple(r) for r in pass_counts(cells, CellCodec(13), 3).collect())
    with pytest.raises(SpecError):
        pruning.by_pass(cells, CellCodec(13), 13)


# ----- loads -----


def test_loads_and_planted_overflow(spark, tmp_path):
    even = spark.range(20_000).select(F.col("id").alias("v"))
    grid = Grid(30, 1, 34)
    quiet = tables.load_report(table_draws(even, ["v"], mixed=True), grid, 2).collect()
    assert {(r["kind"], r["unit"]) for r in quiet} == {(k, u) for k in ("pass", "interval", "class") for u in range(4)} and not any(r["alarm"] for r in quiet)
    assert {r["cap"] for r in quiet} == {stats.headroom(20_000, 2)}
    hot = table_draws(even.unionByName(spark.range(30_000).select((F.lit(1 << 28) + F.col("id") % 10).alias("v"))), ["v"])
    found = {(r["kind"], r["unit"]): r["alarm"] for r in tables.load_report(hot, grid, 2).collect()}
    assert found["interval", 1] and not found["pass", 1] and found["class", 0]


def test_loads_scan_their_table_once(spark, tmp_path):
    spark.range(3000).select(F.col("id").alias("v")).write.parquet(str(tmp_path / "t"))
    source = spark.read.parquet(str(tmp_path / "t"))
    found = tables.load_report(table_draws(source, ["v"]), Grid(12, 1, 52), 2)
    (tmp_path / "t").rename(tmp_path / "gone")  # what is counted lies in stored cells now
    assert sum(r["load"] for r in found.where("kind = 'interval'").collect()) == 3000
    assert str(tmp_path / "t") not in found._jdf.queryExecution().executedPlan().toString()


# ----- shares -----


def test_shares_resume_and_combine(spark, tmp_path, monkeypatch):
    table = spark.range(4000).select((F.col("id") * 7919 % 3001).alias("v"))
    grid, path = Grid(12, 1, 52), str(tmp_path / "units")
    whole = pass_counts(points(table_draws(table, ["v"]), grid).withColumn("rep", F.lit(1)), CellCodec(12)).first()
    count, calls = tables.count_share, []

    def lost(*a, **k):
        if len(calls) == 2:
            raise RuntimeError("driver lost")
        calls.append(a[5])
        return count(*a, **k)

    monkeypatch.setattr(tables, "count_share", lost)
    with pytest.raises(RuntimeError, match="driver lost"):
        tables.run_shares(table, ["v"], grid, 4, 5, path)
    with pytest.raises(tables.IncompleteRun):
        tables.combined(spark, path, grid, 4)
    monkeypatch.setattr(tables, "count_share", count)
    assert tables.run_shares(table, ["v"], grid, 4, 5, path) == [2, 3, 4] and calls == [0, 1]
    assert tables.run_shares(table, ["v"], grid, 4, 5, path) == []
    tables.append_share(count(table, ["v"], grid, 4, 5, 3), path)  # again: replaced, not doubled
    got = tables.combined(spark, path, grid, 4).first()
    assert (got["points"], got["collisions"]) == (whole["points"], whole["collisions"])
    assert math.isclose(got["mean"], stats.expected_collisions(4000, 4096), rel_tol=1e-12)
    assert math.isclose(got["p_value"], stats.p_value(got["collisions"], got["mean"]).value, rel_tol=1e-9)
    tables.append_share(count(table, ["v"], grid, 4, 5, 3).withColumn("share", F.lit(9)), path)
    with pytest.raises(tables.IncompleteRun):
        tables.combined(spark, path, grid, 4)
    with pytest.raises(SpecError):
        tables.run_shares(table, ["v"], grid, 2, 5, path)


def test_shares_of_spacing_classes(spark, tmp_path):
    table = spark.range(3000).select((F.col("id") * F.col("id") % 50_021).alias("v"))
    grid, path = Grid(17, 1, 47), str(tmp_path / "units")
    assert tables.run_shares(table, ["v"], grid, 3, 3, path, birthday=True) == [0, 1, 2]
    got = tables.combined(spark, path, grid, 3, birthday=True).first()
    want = equal_gaps([i * i % 50_021 for i in range(3000)], 2**17)[0]
    assert (got["points"], got["collisions"]) == want and math.isclose(got["mean"], 3000**3 / 2**19, rel_tol=1e-12)


# ----- streams -----


def test_stream_sends_changed_passes_only(spark, tmp_path):
    grid, b = Grid(8, 1, 56), 2
    batches = [[3, 3, 70], [3, 200], [], [70, 71, 255]]
    made, seen = str(tmp_path / "out"), []
    for k, values in enumerate(batches):
        if values:
            spark.createDataFrame([(v,) for v in values], "v long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("v long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = change_writer(table_draws(stream, ["v"]), grid, made, b).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        changes = spark.read.schema("pass long, points long, collisions long, batch long").parquet(made)
        rows = {(r["batch"], r["pass"], r["points"], r["collisions"]) for r in changes.collect()}
        seen.append(rows - set().union(*seen))
        every = [v for part in batches[: k + 1] for v in part]
        want = {p: (len(own), len(own) - len(set(own))) for p in range(4) if (own := [v for v in every if v // 64 == p])}
        assert {r["pass"]: (r["points"], r["collisions"]) for r in latest(changes).collect()} == want
    assert [sorted({r[1] for r in rows}) for rows in seen] == [[0, 1], [0, 3], [], [1, 3]]


def test_statistics_queries_do_not_collect(spark):
    import inspect

    for name in ("expected_collisions_table", "p_values", "birthday_means", "headroom_table"):
        assert "collect" not in inspect.getsource(QUERIES[name])
    assert set(QUERIES) == set(ORACLE)
