"""Exact top-k inner-product search by distributed histogram selection.

Vectors are turned into integers once and stored, candidates in one table, queries in another that is parted into blocks
of about ``BLOCK`` queries or ``BLOCK_BYTES`` by a hash.  A block is broadcast; every candidate
row is scored against it where it lies.  Scores are integers.  Each pass counts scores per query in histogram bins over
the range that still holds the k-th value; counts are added up before they are compared, and the bin with the k-th value
becomes the next, finer range, until a bin is one integer.  A last pass returns all scores above the k-th value and, of
the ties at it, as many of the smallest ids in each task as the query still needs.  A task sends only the bins down to
its own k-th score (the global one cannot lie below), so what is sent does not grow with rows.  Results of all blocks
lie in one folder, so the plan that reads them is the same for any number of blocks.

Defined results: vectors that are null, empty-handed of an id (null id), or hold null or non-finite components take no
part; vectors are compared with vectors of their own length only, empty ones and very long ones too; a query row does
not return itself, but other rows with its id count as candidates; repeated query rows are searched once; fewer
candidates than k give fewer ranks; scores beyond 64 bits are clamped to the long range before they are compared; an
empty table gives an empty result; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.storage import delete_at_exit, shared_folder
from .common import lean, written

K = 20
SCALE = 64
EVERY = 20
BLOCK = 8192  # queries, fewer where their vectors are long
BLOCK_BYTES = 32 << 20
BINS = 256
_CELLS = 1 << 22  # scores held at once
_EXACT = 1 << 53
_LIMIT = (1 << 63) - 1


def quantised(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(id, vec) rows -> by vector length, ids and integer-valued vectors of the rows that take part."""
    vec, ids = batch.column("vec"), batch.column("id")
    sizes = np.diff(np.asarray(vec.offsets)).astype(np.int64)
    flat = vec.values.slice(vec.offsets[0].as_py(), int(sizes.sum())) if len(vec) else vec.values
    values = np.where(np.asarray(flat.is_valid()), flat.to_numpy(zero_copy_only=False).astype(np.float64), np.nan)
    starts = np.cumsum(sizes) - sizes
    here = np.asarray(vec.is_valid()) & np.asarray(ids.is_valid())
    ids = np.where(here, ids.fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    out = {}
    for size in np.unique(sizes[here]).tolist():
        rows = np.flatnonzero(here & (sizes == size))
        x = np.floor(SCALE * values[starts[rows][:, None] + np.arange(size)])
        fine = np.isfinite(x).all(axis=1)
        if fine.any():
            out[size] = ids[rows[fine]], x[fine]
    return out


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vec) rows -> (id, size, vec) of those that take part; vec holds the bytes of float32 where that is exact."""
    for batch in batches:
        for size, (ids, x) in quantised(batch).items():
            narrow = x.astype(np.float32)
            x = narrow if (narrow == x).all() else x
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(np.full(len(ids), size, np.int32)), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "size", "vec"])


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(id, size, vec) rows of one size -> ids and vectors, first those stored narrow, then the wide ones."""
    ids, vecs, size = batch.column("id").to_numpy(), batch.column("vec").to_pylist(), batch.column("size")[0].as_py() if batch.num_rows else 0
    wide = np.array([len(v) == 8 * size for v in vecs], bool) if size else np.zeros(len(vecs), bool)
    for kind, of in ((np.float32, ~wide), (np.float64, wide)):
        rows = np.flatnonzero(of)
        if len(rows):
            x = np.frombuffer(b"".join(vecs[i] for i in rows.tolist()), kind).reshape(len(rows), size)
            yield ids[rows], x.astype(np.float64)


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products: float64 where no sum can pass 2^53, else Python integers, clamped to 64 bits."""
    if np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * max(queries.shape[1], 1) < _EXACT:
        return (queries @ rows.T).astype(np.int64)
    whole = [[int(v) for v in r] for r in rows]
    return np.array([[_clamp(sum(x * y for x, y in zip(q, r))) for r in whole] for q in ([int(v) for v in x] for x in queries)], np.int64)


def _clamp(n: int) -> int:
    return min(max(n, -_LIMIT), _LIMIT)


class _Block:
    """A broadcast block of queries of one length."""

    def __init__(self, spark: SparkSession, vectors: np.ndarray):
        self.shared = spark.sparkContext.broadcast(vectors)

    def each(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores of queries x rows) of the candidates, portion by portion."""
        queries = self.shared.value
        step = max(1, _CELLS // len(queries))
        for batch in batches:
            for ids, rows in _matrices(batch):
                for a in range(0, len(ids), step):
                    yield ids[a : a + step], _scores(queries, rows[a : a + step])


def _histogram(block: _Block, low: list[int], width: list[int], valid: list[int], need: list[int]):
    """Task: (query, bin, n) for scores from ``low`` in ``valid`` bins, down to the task's own need-th score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = max(valid)
        counts = np.zeros((len(low), bins), np.int64)
        least = np.array(low, np.int64)[:, None]
        shift = np.array([w.bit_length() - 1 for w in width], np.uint64)[:, None]
        some = np.array(valid, np.uint64)[:, None]
        base = np.arange(len(low), dtype=np.uint64)[:, None] * np.uint64(bins)
        for _, s in block.each(batches):
            at = (s.view(np.uint64) - least.view(np.uint64)) >> shift
            inside = (s >= least) & (at < some)
            counts += np.bincount((base + at)[inside].astype(np.int64), minlength=counts.size).reshape(counts.shape)
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        q, b = np.nonzero((counts > 0) & (above < np.array(need)[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(b), pa.array(counts[q, b])], names=["q", "bin", "n"])

    return run


def _chosen(block: _Block, kth: list[int], need: list[int]):
    """Task: all (query, id, score) above the k-th value, and as many of the smallest ids at it as are needed."""

    def rows(q, ids, scores):
        return pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids), pa.array(scores)], names=["q", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.array(kth, np.int64)[:, None]
        ties: dict[int, np.ndarray] = {}
        for ids, s in block.each(batches):
            q, r = np.nonzero(s > level)
            yield rows(q, ids[r], s[q, r])
            q, r = np.nonzero(s == level)
            cuts = np.flatnonzero(np.diff(q)) + 1
            for qs, rs in zip(np.split(q, cuts), np.split(r, cuts)):
                if len(qs):
                    k = int(qs[0])
                    ties[k] = np.sort(np.r_[ties.get(k, ids[:0]), ids[rs]])[: need[k]]
        if ties:
            q = np.repeat(np.array(list(ties), np.int64), [len(x) for x in ties.values()])
            yield rows(q, np.concatenate(list(ties.values())), np.array(kth, np.int64)[q])

    return run


def _largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: for each vector length how many candidates there are, and their largest component."""
    seen: dict[int, tuple[int, int]] = {}
    for batch in batches:
        for size in np.unique(batch.column("size").to_numpy()).tolist():
            of = batch.filter(pa.array(batch.column("size").to_numpy() == size))
            for ids, x in _matrices(of):
                n, top = seen.get(size, (0, 0))
                seen[size] = n + len(ids), max(top, int(np.abs(x).max(initial=0)))
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(seen), pa.int32()), pa.array([n for n, _ in seen.values()], pa.int64()), pa.array([str(t) for _, t in seen.values()], pa.string())],
        names=["size", "n", "top"])


def _refined(found: pa.Table, low: list[int], width: list[int], valid: list[int], need: list[int], bins: int) -> None:
    """Take the bin with the k-th score of each query as its next range; changes the lists."""
    q, b, n = (found.column(c).to_numpy() for c in ("q", "bin", "n"))
    order = np.lexsort((-b, q))
    q, b, n = q[order], b[order], n[order]
    firsts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    so_far = np.cumsum(n)
    for start, end in zip(firsts.tolist(), [*firsts[1:].tolist(), len(q)]):
        k = int(q[start])
        before = int(so_far[start] - n[start])
        at = start + int(np.searchsorted(so_far[start:end], before + need[k]))
        need[k] -= int(so_far[at] - n[at]) - before
        low[k] += int(b[at]) * width[k]
        fine = max(1, width[k] // bins)
        valid[k] = width[k] // fine if width[k] > 1 else 0  # 0: the k-th value is found
        width[k] = fine


def _search_block(spark: SparkSession, rows: DataFrame, ids: np.ndarray, vectors: np.ndarray, count: int, reach: int, k: int, bins: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of one block.  The query's own row counts among the k + 1 best, then goes.

    count, reach: how many candidates there are, and their largest component.
    """
    block = _Block(spark, vectors)
    bound = [_clamp(reach * sum(abs(int(v)) for v in x)) for x in vectors]  # no score lies beyond
    low, need = [-n for n in bound], [min(k + 1, count)] * len(ids)
    width = [1 << (2 * n // bins).bit_length() for n in bound]
    valid = [bins] * len(ids)
    while any(valid):
        counted = rows.mapInArrow(lean(_histogram(block, low, width, valid, need)), "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        _refined(counted.toArrow(), low, width, valid, need, bins)  # the highest bins of each query in the block
    found = rows.mapInArrow(lean(_chosen(block, low, need)), "q long, vec_id long, score long")
    own = np.array([_clamp(sum(int(v) ** 2 for v in x)) for x in vectors], np.int64)
    asked = spark.createDataFrame(pa.table({"q": np.arange(len(ids)), "query_id": ids, "own": own}))  # a row a query of the block
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    own_at = F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own")), F.col("at"))
    return (
        found.join(F.broadcast(asked), "q")
        .withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1)
        .withColumn("self", F.min(own_at).over(Window.partitionBy("q")))
        .where(F.col("self").isNull() | (F.col("at") != F.col("self")))
        .withColumn("rank", (F.col("at") - F.when(F.col("at") > F.col("self"), 1).otherwise(0)).cast("int")).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


FOUND = "query_id long, rank int, vec_id long, score long"


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, bins: int = BINS, id_col: str = "vec_id",
          vec_col: str = "embedding") -> DataFrame:
    """Each query's k highest inner products over ``vectors``: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    whole = lambda df: written(
        df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
        .mapInArrow(lean(_integers), "id long, size int, vec binary"))
    rows = whole(vectors)
    asked = whole(queries).distinct()
    asked = written(asked.withColumn("part", F.xxhash64("id", "vec")))
    seen: dict[int, tuple[int, int]] = {}
    for r in rows.mapInArrow(_largest, "size int, n long, top string").collect():  # a row for each task and vector length
        n, top = seen.get(r["size"], (0, 0))
        seen[r["size"]] = n + r["n"], max(top, int(r["top"]))
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    done = 0
    for size, n in sorted((r["size"], r["n"]) for r in asked.groupBy("size").agg(F.count("*").alias("n")).collect()):  # a row a vector length
        blocks = -(-n // max(1, min(block, BLOCK_BYTES // (8 * max(size, 1)))))
        mine, against = asked.where(F.col("size") == size), rows.where(F.col("size") == size)
        for part in range(blocks):
            held = mine.where(F.pmod("part", F.lit(blocks)) == part).select("id", "size", "vec").toArrow()  # about ``block`` queries
            if held.num_rows:
                found = list(_matrices(held.combine_chunks().to_batches()[0]))
                ids, x = np.concatenate([i for i, _ in found]), np.concatenate([x for _, x in found])
                _search_block(spark, against, ids, x, *seen[size], k, bins).write.mode("append").parquet(path)
                done += 1
    if not done:
        return spark.createDataFrame([], FOUND)
    delete_at_exit(spark, path)
    return spark.read.schema(FOUND).parquet(path)


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(rows, rows.where(F.col("vec_id") % EVERY == 0))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
