"""Two-pass external shuffle into shards of equal row counts (law ``rows``).

Pass one scatters whole records into buckets of about ``BUCKET_BYTES`` by a seeded hash of their id, on two levels:
runs of buckets are dealt to at most ``MOST_TASKS`` tasks by the shuffle, and each task's sort, which spills, parts its
run into buckets.  Pass two takes one bucket at a time into memory, puts it into Fisher-Yates order with a generator
seeded by (seed, bucket), and writes it to the shared folder.  Bucket after bucket is then one uniformly random order
of all rows; equal ranges of it are the shards, so shard sizes differ by one row at most.  Rows are numbered within a
task as they are written; only the rows of each task are counted, collected and broadcast, ``MOST_TASKS`` numbers at most.

A bucket that is far larger than a fair share can only come from one id that repeats (or is null) very often; rows of
such a bucket are scattered over more buckets by their position in the input.  Buckets are sorted before they are
shuffled, so a recomputed task writes the same rows in the same order.

Defined results: a null text has size 8 and the checksum of the empty text; repeated rows each get their own slot; rows
with a null id are scattered like one repeated id; a very long text is moved whole with its record; an empty table gives an empty result; extra columns travel along in
``shuffled`` under their own names, with the columns added here renamed where they would clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, lean, written

SHARDS = 24
SEED = 20
BUCKET_BYTES = 32 << 20
CELLS = 4096
MOST_TASKS = 8192


def fisher_yates(count: int, rng: np.random.Generator) -> np.ndarray:
    """A uniformly random order of range(count): position i swaps with a position from i to the end."""
    order = list(range(count))
    picks = rng.integers(np.arange(count), count).tolist() if count else []
    for i, j in enumerate(picks):
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def _bucketed(docs: DataFrame, bucket: str, tie: str, seed: int, id_col: str, text_col: str, bucket_bytes: int) -> tuple[DataFrame, int]:
    """``docs`` with its bucket number and a sort key, and the number of buckets."""
    mixed = F.xxhash64(F.lit(seed), F.col(id_col))
    size = F.coalesce(F.octet_length(text_col), F.lit(0)) + 64
    cells = docs.groupBy(F.pmod(mixed, F.lit(CELLS)).alias("cell")).agg(F.sum(size).alias("bytes"), F.count("*").alias("rows")).collect()  # CELLS rows at most
    total = sum(r["bytes"] for r in cells)
    buckets = max(64, -(-total // bucket_bytes))
    fair = total / CELLS
    hot = [r["cell"] for r in cells if r["rows"] > 64 and r["bytes"] > max(8 * fair, bucket_bytes / 64)]
    number = F.pmod(F.shiftrightunsigned(mixed, 12), F.lit(buckets))
    if hot:
        spread = F.pmod(F.xxhash64(F.lit(seed + 1), F.monotonically_increasing_id()), F.lit(buckets))
        number = F.when(F.pmod(mixed, F.lit(CELLS)).isin(hot), spread).otherwise(number)
    return docs.withColumn(bucket, number.cast("int")).withColumn(tie, F.xxhash64(F.lit(seed + 2), F.col(id_col))), buckets


def shuffled(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``docs`` with the columns shard and slot (gapless from 0 in each shard); the rows lie in files, bucket by bucket."""
    bucket, tie, task, place = (fresh(docs, x) for x in ("bucket", "tie", "task", "place"))
    rows, buckets = _bucketed(docs, bucket, tie, seed, id_col, text_col, bucket_bytes)
    per_task = -(-buckets // MOST_TASKS)
    schema = T.StructType([*docs.schema.fields, T.StructField(task, T.IntegerType()), T.StructField(place, T.LongType())])
    at = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0

        def out(parts: list[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
            nonlocal done
            table = pa.Table.from_batches(parts)
            order = fisher_yates(table.num_rows, np.random.default_rng([seed, number]))
            for a in range(0, len(order), 1000):
                some = table.take(pa.array(order[a : a + 1000])).combine_chunks()
                columns = [c.chunk(0) for c in some.columns[:at]]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(np.full(len(some), number // per_task, np.int32)), pa.array(np.arange(done, done + len(some)))],
                    names=[f.name for f in schema.fields])
                done += len(some)

        held, number = [], None
        for batch in batches:
            numbers = batch.column(at).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            plain = batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    if held and numbers[a] != number:
                        yield from out(held, number)
                        held = []
                    number = int(numbers[a])
                    held.append(plain.slice(a, b - a).select(list(range(at))))
        if held:
            yield from out(held, number)

    content = [F.crc32(F.col(text_col).cast("binary"))] if text_col in docs.columns else []
    number = F.floor(F.col(bucket) / per_task).cast("int")
    dealt = rows.repartitionById(-(-buckets // per_task), number).sortWithinPartitions(bucket, tie, id_col, *content)
    lying = written(dealt.mapInArrow(lean(run), schema))
    counts = {r[task]: r["n"] for r in lying.groupBy(task).agg(F.count("*").alias("n")).collect()}  # MOST_TASKS rows at most
    before, table = 0, []
    for number in sorted(counts):
        table.append((number, before))
        before += counts[number]
    base, extra = divmod(before, shards)
    first, number2 = fresh(lying, "first"), fresh(lying, "number")
    offsets = docs.sparkSession.createDataFrame(table, f"`{number2}` int, `{first}` long")
    rank = F.col(first) + F.col(place)
    long_rows = extra * (base + 1)  # the first shards have one row more
    shard = F.when(rank < long_rows, F.floor(rank / (base + 1))).otherwise(extra + F.floor((rank - long_rows) / max(base, 1)))
    found = lying.join(F.broadcast(offsets), F.col(task) == F.col(number2))
    shard_name, slot_name = fresh(docs, "shard"), fresh(docs, "slot")
    return (
        found.select(*docs.columns, rank.alias(place), shard.cast("int").alias(shard_name))
        .withColumn(slot_name, (F.col(place) - F.expr(_start_sql(shard_name, base, extra, long_rows))).cast("long")).drop(place)
    )


def _start_sql(shard: str, base: int, extra: int, long_rows: int) -> str:
    """Rank of a shard's first row."""
    return f"CASE WHEN `{shard}` < {extra} THEN `{shard}` * {base + 1}L ELSE {long_rows}L + (`{shard}` - {extra}) * {base}L END"


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the shards as Parquet below ``path``/shard=N, rows in slot order within each file."""
    out = shuffled(docs, shards, seed, id_col=id_col, text_col=text_col)
    shard, slot = out.columns[-2:]
    out.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def digest(lying: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return lying.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(shuffled(docs))
