"""The two jobs: growing input, reruns, odd rows, command lines."""

import json
import logging
import shutil

import pytest
from pyspark.sql import functions as F

from jobs import common, digest_audit, id_monitor
from jobs.common import config_of
from spacelab.functions import stats

AUDIT = {"digests": ["md5", "sha1"], "collision_bits": 20, "interval_bits": 2, "spacing_bits": 40, "class_bits": 1}
WATCH = {"columns": ["a", "b"], "bits": 8, "interval_bits": 2, "mixed": True, "files_per_batch": 2}


def files(path):
    return sorted(p.relative_to(path).as_posix() for p in path.rglob("*.parquet"))


def test_digest_audit(spark, tmp_path, caplog):
    rows = [(1, "one two\tthree one", "en", 1), (2, None, "de", 1), (3, "", "de", 1), (4, " \n", None, 1), (5, " ".join(f"w{i}" for i in range(3000)), "en", 1), (6, "Eins eins\x0bzwei", None, 1)]
    spark.createDataFrame(rows, "doc_id int, text string, lang string, rep int").write.parquet(str(tmp_path / "docs"))
    with caplog.at_level(logging.INFO, "jobs"):
        first = digest_audit.audit(spark, str(tmp_path / "docs"), str(tmp_path / "out"), AUDIT).collect()
    assert "read 6 documents" in caplog.text and "3006 distinct words" in caplog.text and f"wrote {len(first)} rows" in caplog.text
    from hashlib import md5, sha1

    words = {"en": {"one", "two", "three", *(f"w{i}" for i in range(3000))}, "und": {"Eins", "eins", "zwei"}}
    for name, digest in (("md5", md5), ("sha1", sha1)):
        for lang, known in words.items():
            cells = [int(digest(w.encode()).hexdigest()[:15], 16) >> 40 for w in known]
            row = [r for r in first if (r["digest"], r["test"], r["lang"]) == (name, "collision", lang)]
            assert [(r["points"], r["collisions"]) for r in row] == [(len(cells), len(cells) - len(set(cells)))]
            assert row[0]["mean"] == round(stats.expected_collisions(len(cells), 2**20), 6)
            units = [r for r in first if (r["digest"], r["test"], r["lang"]) == (name, "collision_by_interval", lang)]
            assert sum(r["points"] for r in units) == len(cells) and {r["unit"] for r in units} == {c >> 18 for c in cells}
            gaps = [r for r in first if (r["digest"], r["test"], r["lang"]) == (name, "birthday_by_class", lang)]
            assert sum(r["points"] for r in gaps) == len(cells)
    there = [p.name for p in sorted((tmp_path / "out").iterdir()) if p.is_dir()]
    assert there == ["digest=md5", "digest=sha1"]
    again = digest_audit.audit(spark, str(tmp_path / "docs"), str(tmp_path / "out"), AUDIT).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, first))


def test_digest_audit_of_nothing_and_wrong_settings(spark, tmp_path):
    spark.createDataFrame([], "text string, lang string").write.parquet(str(tmp_path / "none"))
    assert digest_audit.audit(spark, str(tmp_path / "none"), str(tmp_path / "out"), AUDIT).count() == 0
    for bad in ({"digests": ["md4"]}, {"collision_bits": 61}, {"interval_bits": 21}):
        with pytest.raises(ValueError):
            digest_audit.audit(spark, str(tmp_path / "none"), str(tmp_path / "out"), AUDIT | bad)


def test_monitor_takes_only_what_is_new(spark, tmp_path, caplog):
    """Two runs over a growing table, a run without anything new, and a whole run over all: the same state."""
    table = spark.range(6000).select((F.col("id") % 5000).alias("a"), (F.col("id") % 7).alias("b"), F.lit("x").alias("batch"))
    parts = [table.where(f"a % 3 = {k}") for k in range(3)]
    grown = tmp_path / "grown"
    parts[0].repartition(3).write.parquet(str(grown))
    run = lambda name, ids: id_monitor.monitor(spark, str(ids), str(tmp_path / name), str(tmp_path / f"{name}-check"), WATCH)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with caplog.at_level(logging.INFO, "jobs"):
        first = run("one", grown).collect()
        assert f"read {parts[0].count()} new rows" in caplog.text
        caplog.clear()
        parts[1].repartition(2).write.mode("append").parquet(str(grown))
        parts[2].coalesce(1).write.mode("append").parquet(str(grown))
        second = run("one", grown).collect()
        assert f"read {parts[1].count() + parts[2].count()} new rows" in caplog.text
        caplog.clear()
        kept = files(tmp_path / "one" / "changes")
        third = run("one", grown).collect()
        assert "read 0 new rows" in caplog.text and files(tmp_path / "one" / "changes") == kept
    whole = run("two", grown).collect()
    order = lambda rows: sorted(map(tuple, rows))
    assert order(second) == order(third) == order(whole) and sum(r["points"] for r in first) == parts[0].count() and sum(r["points"] for r in second) == 6000
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    assert sum(r["collisions"] for r in second) >= 0 and {r["interval"] for r in second} == {0, 1, 2, 3} and not any(r["alarm"] for r in second)


def test_monitor_survives_a_lost_run(spark, tmp_path):
    """The state is lost after the stream took a file: the next run makes it from the changes."""
    spark.range(500).select(F.col("id").alias("a"), F.col("id").alias("b")).write.parquet(str(tmp_path / "ids"))
    run = lambda: sorted(map(tuple, id_monitor.monitor(spark, str(tmp_path / "ids"), str(tmp_path / "out"), str(tmp_path / "check"), WATCH).collect()))
    first = run()
    shutil.rmtree(tmp_path / "out" / "state")
    assert run() == first


def test_monitor_of_odd_tables(spark, tmp_path):
    spark.createDataFrame([], "a long, b long").write.parquet(str(tmp_path / "none"))
    assert id_monitor.monitor(spark, str(tmp_path / "none"), str(tmp_path / "o1"), str(tmp_path / "c1"), WATCH).count() == 0
    rows = [(None, 1), (1, None), (5, 5)] * 300
    spark.createDataFrame(rows, "a long, b long").coalesce(1).write.parquet(str(tmp_path / "odd"))
    single = next((tmp_path / "odd").glob("*.parquet"))  # one file, by its own path
    got = id_monitor.monitor(spark, str(single), str(tmp_path / "o2"), str(tmp_path / "c2"), WATCH).collect()
    assert [(r["points"], r["collisions"], r["alarm"]) for r in got] == [(300, 299, False)]
    with pytest.raises(ValueError):
        id_monitor.monitor(spark, str(tmp_path / "odd"), str(tmp_path / "o3"), str(tmp_path / "c3"), WATCH | {"interval_bits": 17})


def test_monitor_alarm(spark, tmp_path):
    spark.range(40_000).select(F.lit(3).cast("long").alias("a"), F.col("id").alias("b")).write.parquet(str(tmp_path / "ids"))
    got = id_monitor.monitor(spark, str(tmp_path / "ids"), str(tmp_path / "out"), str(tmp_path / "check"), WATCH).collect()
    assert [r["alarm"] for r in got] == [True] and (tmp_path / "out" / "state" / "alarm=true").is_dir()


def test_command_lines_and_configuration(spark, tmp_path):
    spark.createDataFrame([("a b c", "en")], "text string, lang string").write.parquet(str(tmp_path / "docs"))
    (tmp_path / "c.json").write_text(json.dumps({"digests": ["md5"]}))
    arguments = ["--documents", str(tmp_path / "docs"), "--output", str(tmp_path / "out"), "--config", str(tmp_path / "c.json")]
    assert digest_audit.main(arguments, spark) == 0 and spark.range(1).count() == 1  # the session goes on
    assert [p.name for p in (tmp_path / "out").iterdir() if p.is_dir()] == ["digest=md5"]
    spark.range(9).select(F.col("id").alias("event_id"), F.col("id").alias("user_id")).write.parquet(str(tmp_path / "ids"))
    assert id_monitor.main(["--ids", str(tmp_path / "ids"), "--output", str(tmp_path / "o"), "--checkpoint", str(tmp_path / "c")], spark) == 0
    with pytest.raises(SystemExit):
        id_monitor.main(["--ids", "x"], spark)
    (tmp_path / "bad.json").write_text(json.dumps({"digest": 1}))
    with pytest.raises(ValueError, match="unknown settings digest"):
        config_of(common.Path(digest_audit.__file__), str(tmp_path / "bad.json"))


def test_jobs_import_nothing_from_the_training_data_operators():
    from pathlib import Path

    for file in [*Path(digest_audit.__file__).parent.glob("*.py"), Path(__file__)]:
        text = file.read_text()
        assert "corpus_" + "pipeline" not in text and "spacelab" + ".llm" not in text
