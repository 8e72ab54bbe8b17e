"""Digest audit: do digests of the words of a corpus look like draws of a good generator?

    python -m jobs.digest_audit --documents PATH --output PATH [--config FILE]

Identifiers, shards and samples of data sets are often cut from digests of text.  This job takes every distinct word of
every whole text, language by language, cuts its digests to some bits, and runs the collision test by value intervals
and the birthday-spacings test by classes on them.  A p-value near 0 says that the cut digests meet too often, one near
1 that they avoid each other.

Output: Parquet, partitioned by digest and test, (lang, unit, points, collisions, mean, p_value).  Test ``collision``
and ``birthday`` have one row a language (unit 0), ``collision_by_interval`` and ``birthday_by_class`` one for each unit
that has points.  Counts of the birthday tests are equal spacings; the points of a class are its spacings.  A run
replaces the partitions that it makes, so a run again gives the same result.

Defined results: a null language is ``und``; null texts and texts without words add nothing; repeated words count once
a language; an empty table gives an empty output; extra columns are not read.
"""

from __future__ import annotations

import sys
from math import factorial
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, config_of, log
from spacelab.functions.columns import expected_collisions_of
from spacelab.operators.cells import CellCodec
from spacelab.operators.spacings import spacings
from spacelab.plans.tables import class_report, counted_cells, repetition_counts, seen_by, with_p
from spacelab.sources.storage import stored

DIGESTS = {"md5": F.md5, "sha1": F.sha1, "sha256": lambda c: F.sha2(c, 256)}
COLUMNS = ["lang", "unit", "points", "collisions", "mean", "p_value", "digest", "test"]
SCHEMA = "lang string, unit long, points long, collisions long, mean double, p_value double, digest string, test string"


def words(documents: DataFrame) -> DataFrame:
    """(lang, word): the distinct words of each language, from whole texts."""
    word = F.explode(F.split(F.col("text").cast("string"), "[\\x09-\\x0D\\x20]+")).alias("word")
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    return documents.select(lang, word).where("word <> ''").distinct()


def _first_bits(digest: Column, bits: int) -> Column:
    """The upper bits of a hexadecimal digest, 60 at most."""
    return F.shiftright(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), 60 - bits)


def _rounded(df: DataFrame, unit: Column, points: str, test: str) -> DataFrame:
    return df.select(
        "rep", unit.cast("long").alias("unit"), F.col(points).cast("long").alias("points"), F.col("collisions").cast("long").alias("collisions"),
        F.round("mean", 6).alias("mean"), F.round("p_value", 6).alias("p_value"), F.lit(test).alias("test"))


def audit(spark: SparkSession, documents: str, output: str, config: dict) -> DataFrame:
    """Run the job on plain paths; returns the output read back."""
    unknown = sorted(set(config["digests"]) - set(DIGESTS))
    if unknown:
        raise ValueError(f"unknown digests {', '.join(unknown)}; known are {', '.join(DIGESTS)}")
    for bits, cut in (("collision_bits", "interval_bits"), ("spacing_bits", "class_bits")):
        if not 0 <= config[cut] <= config[bits] <= 60 or config[bits] < 2:
            raise ValueError(f"{bits} = {config[bits]} and {cut} = {config[cut]}: 2 to 60 bits, cut by no more than it has")
    read, found = Observation(), Observation()
    rows = spark.read.parquet(documents).observe(read, F.count(F.lit(1)).alias("rows"), F.sum(F.length("text")).alias("characters"))
    known = stored(words(rows).observe(found, F.count(F.lit(1)).alias("words")))
    log.info("read %s documents of %s characters from %s: %s distinct words", seen_by(read, "rows"), seen_by(read, "characters"), documents, seen_by(found, "words"))
    digests = F.explode(F.array(*(F.struct(F.lit(d).alias("digest"), DIGESTS[d]("word").alias("hex")) for d in config["digests"]))).alias("d")
    rep = F.xxhash64("d.digest", "lang").alias("rep")  # one repetition for each digest and language
    # short cuts of the digests are kept, never words again
    hashed = known.select("lang", "word", digests)
    bits, steps = config["collision_bits"], config["spacing_bits"]
    cells = stored(hashed.select(rep, "lang", F.col("d.digest").alias("digest"), _first_bits(F.col("d.hex"), bits).alias("cell"), _first_bits(F.col("d.hex"), steps).alias("far")))
    names = cells.select("rep", "lang", "digest").distinct()
    near, far = CellCodec(bits), CellCodec(steps)
    counted = counted_cells(cells.select("rep", "cell"), near)
    spread = counted_cells(cells.select("rep", F.col("far").alias("cell")), far)
    gaps = spacings(spread, far, counted=True)
    cut = config["interval_bits"]
    intervals = counted.groupBy("rep", near.top(cut).alias("unit")).agg(F.sum("n").alias("points"), F.sum(F.col("n") - 1).alias("collisions"))
    parts = [
        _rounded(with_p(repetition_counts(counted, near)), F.lit(0), "points", "collision"),
        _rounded(with_p(intervals.withColumn("mean", expected_collisions_of("points", 2.0 ** (bits - cut)))), F.col("unit"), "points", "collision_by_interval"),
        _rounded(with_p(repetition_counts(spread, far, gaps)), F.lit(0), "points", "birthday"),
        _rounded(class_report(spread, gaps, far, config["class_bits"]), F.col("klass"), "spacings", "birthday_by_class")]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    wrote = Observation()
    result = result.join(names, "rep").select(*COLUMNS).observe(wrote, F.count(F.lit(1)).alias("rows"))
    # few rows a language: one file a partition
    result.repartition("digest", "test").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("digest", "test").parquet(output)
    log.info("wrote %s rows to %s", seen_by(wrote, "rows"), output)
    return spark.read.schema(SCHEMA).parquet(output)


def sql(config: dict) -> str:
    """The same output as SQL over the view documents."""
    bits, steps, k, c = config["collision_bits"], config["spacing_bits"], config["interval_bits"], config["class_bits"]
    digests = ", ".join(f"struct_pack(digest := '{d}', hex := {d}(word))" for d in config["digests"])
    cut = lambda n: f"(CAST('0x' || substr(d.hex, 1, 15) AS BIGINT) >> {60 - n})"
    # n - c + c (1 - 1/c)^n loses digits where c is large; it is n (n-1) / 2! c - n (n-1) (n-2) / 3! c^2 + ...
    falling = lambda n, j: " * ".join(f"(CAST({n} AS DOUBLE) - {i})" for i in range(j))
    terms = lambda n, cells: " + ".join(f"({(-1) ** j}) * {falling(n, j)} / {factorial(j)}.0 / pow({cells}, {j - 1})" for j in range(2, 9))
    return f"""
WITH w AS (SELECT DISTINCT coalesce(lang, 'und') AS lang, unnest(string_split_regex(text, '[\\x09-\\x0D\\x20]+')) AS word FROM documents),
x AS (SELECT lang, unnest([{digests}]) AS d FROM w WHERE word <> ''),
p AS (SELECT lang, d.digest AS digest, {cut(bits)} AS cell, {cut(steps)} AS far FROM x),
cc AS (SELECT lang, digest, cell, count(*) AS n FROM p GROUP BY ALL),
u1 AS (SELECT digest, lang, 'collision' AS test, 0 AS unit, sum(n) AS points, sum(n - 1) AS collisions, {2**bits}.0 AS cells FROM cc GROUP BY digest, lang
  UNION ALL SELECT digest, lang, 'collision_by_interval', cell >> {bits - k}, sum(n), sum(n - 1), {2**(bits - k)}.0 FROM cc GROUP BY digest, lang, cell >> {bits - k}),
f AS (SELECT digest, lang, far - lag(far) OVER (PARTITION BY digest, lang ORDER BY far) AS gap FROM p
  UNION ALL SELECT digest, lang, {2**steps} - max(far) + min(far) FROM p GROUP BY digest, lang HAVING max(far) > min(far)),
g AS (SELECT digest, lang, gap, count(*) AS n FROM f WHERE gap IS NOT NULL GROUP BY ALL),
t AS (SELECT digest, lang, CAST(count(*) AS DOUBLE) AS total FROM p GROUP BY ALL),
u2 AS (SELECT digest, lang, 'birthday' AS test, 0 AS unit, max(total) AS points, sum(n - 1) AS collisions, 1 AS share FROM t LEFT JOIN g USING (digest, lang) GROUP BY digest, lang
  UNION ALL SELECT digest, lang, 'birthday_by_class', gap & {2**c - 1}, sum(n), sum(n - 1), {2**c} FROM g GROUP BY digest, lang, gap & {2**c - 1}),
m AS (SELECT digest, lang, test, unit, points, collisions, CASE WHEN points <= 1 THEN 0 ELSE {terms('points', 'cells')} END AS mean FROM u1
  UNION ALL SELECT digest, lang, test, unit, points, coalesce(collisions, 0), total * total * total / (4 * {2**steps}.0) / share FROM u2 JOIN t USING (digest, lang)),
v AS (SELECT digest, lang, test, unit, points, collisions, mean, sum(exp(k * ln(mean) - mean - lgamma(k + 1))) FILTER (k <= collisions) AS lo,
  sum(exp(k * ln(mean) - mean - lgamma(k + 1))) FILTER (k >= collisions) AS hi FROM m, (SELECT range AS k FROM range(0, 1000)) WHERE mean > 0 GROUP BY ALL
  UNION ALL SELECT digest, lang, test, unit, points, collisions, mean, NULL, NULL FROM m WHERE mean <= 0)
SELECT lang, CAST(unit AS BIGINT) AS unit, CAST(points AS BIGINT) AS points, CAST(collisions AS BIGINT) AS collisions, round(CAST(mean AS DOUBLE), 6) AS mean,
  round(CASE WHEN lo IS NULL THEN CAST('NaN' AS DOUBLE) WHEN hi < lo THEN hi WHEN lo < 0.5 THEN 1 - lo ELSE 0.5 END, 6) AS p_value, digest, test FROM v"""


def run(spark: SparkSession, documents: str, output: str, config: str | None = None) -> None:
    audit(spark, documents, output, config_of(Path(__file__), config))


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    return command_line("Digest audit: collision and birthday-spacings tests of digests of a corpus' words", {
        "documents": "Parquet table with text and lang", "output": "folder to write"}, run, arguments, spark)


if __name__ == "__main__":
    sys.exit(main())
