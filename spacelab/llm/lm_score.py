"""Language-model scores: cross-entropy difference of two matched word bigram models.

The target model learns from a chosen part of the corpus, the background model from all of it.  Both share order,
smoothing and one vocabulary, every word of the corpus and one place for a word that is in none of it.  A token's loss
is its negative log-probability given the word before; a document's score is the mean over its tokens of target loss
minus background loss, lower for texts nearer the target.  A scored document is part of the background, and of the
target if it was chosen; its own counts are not taken out, so a document that occurs twice is likelier than one that
occurs once.

Counting covers every document, word and pair of words.  Documents are dealt by a hash of their id into chunks of about
``CHUNK`` bytes, so the number of chunks grows with the corpus.  A chunk counts each of its words and pairs once and
sends them, as sorted hashes, to buckets; a bucket adds up its share of the count tables and sends each chunk the sums
of what it asked for; the chunk scores its documents with them.  No table of the model is ever in one place, and none
goes to the driver.  Words and pairs are told apart by 64-bit hashes.

Defined results: a null, empty or blank text has 0 tokens and null losses and score; an empty target gives the uniform
model; repeated rows count and score each; rows with a null id are dealt by their text; a very long text is cut into
words piece by piece, and its word numbers (4 bytes a word) are held at once; an empty table gives an empty result;
extra columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_type, keyed_text, pieces, text_bytes

WEIGHT = 0.75  # of the bigram estimate, the rest is the unigram's
CHUNK = 8 << 20


def word_runs(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text in runs of bounded size."""
    for piece in pieces(text.lower()) if text else ():
        yield piece.split()


# ----- every word: count tables in buckets -----

SCORED, TARGET, NAMED = 0, 1, 2  # a row to count and score, a further row of the target, the id of a scored row of the target
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers by byte planes, as many as the largest needs and their count first; the shuffle compresses them well."""
    planes = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    return bytes([planes]) + np.ascontiguousarray(numbers.astype("<u8").ravel().view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()


def _unpacked(data: bytes, width: int = 1) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<i8").reshape(width, -1)


def _packed_keys(keys: np.ndarray, bucket: int, bits: int) -> bytes:
    """Sorted keys of a bucket by their differences."""
    return _packed(np.diff(keys, prepend=np.uint64(bucket << (64 - bits))))


def _unpacked_keys(data: bytes, bucket: int, bits: int) -> np.ndarray:
    return np.cumsum(_unpacked(data)[0].view(np.uint64), dtype=np.uint64) + np.uint64(bucket << (64 - bits))


class _Chunk:
    """The words and pairs of a chunk's texts, each once and in the order of their hashes."""

    def __init__(self, table: pa.Table):
        kinds, ids = table.column("kind").to_numpy(), table.column("id")
        rows = np.flatnonzero(kinds != NAMED)
        named = set(ids.filter(pa.array(kinds == NAMED)).to_pylist())
        self.ids = ids.take(pa.array(rows))
        self.scored = kinds[rows] == SCORED
        near = ~self.scored | np.array([i is not None and i in named for i in self.ids.to_pylist()], bool)
        index: defaultdict[bytes, int] = defaultdict(count(1).__next__)
        found, sizes = [np.zeros(0, np.int32)], np.zeros(len(rows), np.int64)
        for k, text in enumerate(text_bytes(table.column("text").take(pa.array(rows)))):
            for words in word_runs(text):
                found.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
                sizes[k] += len(words)
        after = np.concatenate(found)
        before = np.zeros_like(after)  # 0 is the start
        before[1:] = after[:-1]
        before[(np.cumsum(sizes) - sizes)[sizes > 0]] = 0
        self.sizes, self.row = sizes, np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
        words = len(index) + 1
        hashes = np.frombuffer(b"".join([bytes(8), *(blake2b(w, digest_size=8).digest() for w in index)]), np.uint64)
        cells, at = np.unique(before.astype(np.int64) * words + after, return_inverse=True)
        a, b = np.divmod(cells, words)
        far, near = self.scored[self.row], near[self.row]
        counts = [np.bincount(at[chosen], minlength=len(cells)) for chosen in (far, near)]
        each = lambda ids: [np.bincount(ids[chosen], minlength=words) for chosen in (far, near)]
        with np.errstate(over="ignore"):
            pairs = hashes[a] * _MIX[0] + hashes[b] * _MIX[1]
        orders = [np.argsort(hashes, kind="stable"), np.argsort(pairs, kind="stable")]
        self.keys = [hashes[orders[0]], pairs[orders[1]]]
        self.counts = [np.array([*each(after), *each(before)])[:, orders[0]], np.array(counts)[:, orders[1]]]
        place = [np.empty(len(o), np.int32) for o in orders]
        for p, o in zip(place, orders):
            p[o] = np.arange(len(o), dtype=np.int32)
        self.pair = place[1][at]  # of each token
        back = orders[1]
        self.first, self.second = place[0][a[back]], place[0][b[back]]  # of each pair


def _counted(bits: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        chunk, out = _Chunk(table), []
        for kind, (keys, counts) in enumerate(zip(chunk.keys, chunk.counts)):
            bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
            cuts = np.searchsorted(bucket, np.arange((1 << bits) + 1))
            for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
                if i < j or kind == 0:  # every bucket of words answers, as its totals are needed
                    out.append((k, key[0].as_py(), kind, _packed_keys(keys[i:j], k, bits), _packed(counts[:, i:j])))
        return pa.Table.from_pylist([dict(zip(_COUNTS.names, r)) for r in out], schema=_COUNTS)

    return run


_COUNTS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_SUMS = pa.schema([
    ("bucket", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("counts", pa.binary()), ("words", pa.int64()), ("far", pa.int64()), ("near", pa.int64())])


def _summed(bits: int):
    """What a bucket sends back to each chunk: its counts summed over all chunks, and the totals of the bucket's words."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket, kind = (k.as_py() for k in key)
        rows, width = table.select(["bucket", "chunk", "kind"]).to_pylist(), 2 if kind else 4
        keys = [_unpacked_keys(k, bucket, bits) for k in table.column("keys").to_pylist()]
        ends = np.cumsum([len(k) for k in keys])
        unique, at = np.unique(np.concatenate(keys), return_inverse=True)
        own = [_unpacked(c, width) for c in table.column("counts").to_pylist()]
        total = np.array([np.bincount(at, weights=np.concatenate([n[k] for n in own]), minlength=len(unique)) for k in range(width)]).astype(np.int64)
        sums = dict(words=0, far=0, near=0) if kind else dict(words=int((total[0] > 0).sum()), far=int(total[0].sum()), near=int(total[1].sum()))
        for row, k, end in zip(rows, keys, ends):
            row.update(sums, counts=_packed(total[:, at[end - len(k) : end]]))
        return pa.Table.from_pylist(rows, schema=_SUMS)

    return run


def _scored(weight: float, names: list[str]):
    def run(key: tuple, texts: pa.Table, sums: pa.Table) -> pa.Table:
        chunk = _Chunk(texts)
        parts: tuple[list, list] = ([], [])
        words, far, near = (sum(sums.column(c).to_pylist()) for c in ("words", "far", "near"))
        for r in sorted(sums.select(["bucket", "kind", "counts"]).to_pylist(), key=lambda r: r["bucket"]):
            parts[r["kind"]].append(_unpacked(r["counts"], 2 if r["kind"] else 4))
        means = []
        if len(chunk.pair):
            single, pair = (np.concatenate(p, axis=1) for p in parts)
            for side, total in ((1, near), (0, far)):
                before = single[2 + side][chunk.first]
                share = np.where(before > 0, weight, 0.0)
                once = (single[side][chunk.second] + 1.0) / (total + words + 1)  # the unknown word has a share too
                loss = -np.log(share * pair[side] / np.maximum(before, 1) + (1 - share) * once)
                means.append(np.bincount(chunk.row, weights=loss[chunk.pair], minlength=len(chunk.sizes)) / np.maximum(chunk.sizes, 1))
        else:
            means = [np.zeros(len(chunk.sizes))] * 2
        kept, none = chunk.scored, chunk.sizes[chunk.scored] == 0
        ids = chunk.ids.filter(pa.array(kept))
        return pa.table([ids, pa.array(chunk.sizes[kept]), *(pa.array(m[kept], pa.float64(), mask=none) for m in means)], names=names)

    return run


def _with_every_word(rows: DataFrame, weight: float, schema: T.StructType) -> DataFrame:
    """``rows``: id, text and kind."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = size // CHUNK + 1
    bits = max(7, (chunks // 2).bit_length())
    tasks = int(max(chunks, rows.sparkSession.sparkContext.defaultParallelism))  # tasks grow with the corpus, whatever the session's number is
    dealt = rows.withColumn("chunk", F.pmod(F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("id")), F.lit(chunks))).repartition(tasks, "chunk")
    counted = dealt.groupBy("chunk").applyInArrow(_counted(bits), "bucket int, chunk long, kind int, keys binary, counts binary")
    summed = counted.repartition(tasks, "bucket", "kind").groupBy("bucket", "kind").applyInArrow(
        _summed(bits), "bucket int, chunk long, kind int, counts binary, words long, far long, near long")
    return dealt.groupBy("chunk").cogroup(summed.repartition(tasks, "chunk").groupBy("chunk")).applyInArrow(_scored(weight, schema.names), schema)


def _differences(found: DataFrame, id_col: str) -> DataFrame:
    return found.withColumn("score", F.col("target_loss") - F.col("background_loss")).withColumnRenamed("id", id_col)


def _schema(docs: DataFrame, id_col: str) -> T.StructType:
    return T.StructType([
        T.StructField("id", id_type(docs, id_col)), T.StructField("n_tokens", T.LongType()), T.StructField("target_loss", T.DoubleType()),
        T.StructField("background_loss", T.DoubleType())])


def labelled_difference(docs: DataFrame, good: DataFrame, weight: float = WEIGHT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``cross_entropy_difference``; the target are the rows whose id is in ``good``."""
    names = good.select(F.col(id_col).cast(id_type(docs, id_col)).alias("id"), F.lit(None).cast("string").alias("text"), F.lit(NAMED).alias("kind"))
    rows = keyed_text(docs, id_col, text_col).withColumn("kind", F.lit(SCORED)).union(names.where("id IS NOT NULL"))
    return _differences(_with_every_word(rows, weight, _schema(docs, id_col)), id_col)


def cross_entropy_difference(docs: DataFrame, target: DataFrame, weight: float = WEIGHT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_tokens, target_loss, background_loss, score.  ``target``: rows with ``text_col``."""
    every = keyed_text(docs, id_col, text_col).withColumn("kind", F.lit(SCORED))
    further = target.select(F.lit(None).cast(id_type(docs, id_col)).alias("id"), F.col(text_col).cast("string").alias("text"), F.lit(TARGET).alias("kind"))
    return _differences(_with_every_word(every.union(further), weight, _schema(docs, id_col)), id_col)


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled as good; background: all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    found = labelled_difference(docs, good)  # labels grow with the corpus: they are dealt to the chunks of their documents
    return found.select("doc_id", "n_tokens", *(F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")))


#: Words, pairs and their counts as plain tables; a target without rows of its own is the uniform model here too.
ORACLE = rf"""
WITH doc AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda w: w <> '') AS w FROM documents),
tok AS (SELECT doc_id, unnest(w) AS w, unnest(generate_series(1, len(w))) AS i FROM doc WHERE len(w) > 0),
bi AS (SELECT doc_id, i, w, coalesce(lag(w) OVER (PARTITION BY doc_id ORDER BY i), ' start') AS a FROM tok),
pair AS (
  SELECT a, w, CAST(count(*) AS DOUBLE) AS f, CAST(count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS DOUBLE) AS t FROM bi GROUP BY a, w),
bef AS (SELECT a, sum(f) AS bf, sum(t) AS bt FROM pair GROUP BY a),
one AS (SELECT w, sum(f) AS sf, sum(t) AS st FROM pair GROUP BY w),
tot AS (SELECT sum(f) AS nf, sum(t) AS nt, (SELECT count(*) FROM one) + 2 AS v FROM pair),
loss AS (
  SELECT a, w, -ln((CASE WHEN bf > 0 THEN {WEIGHT} ELSE 0 END) * f / greatest(bf, 1) + (CASE WHEN bf > 0 THEN {1 - WEIGHT} ELSE 1 END) * (sf + 1) / (nf + v - 1)) AS lf,
         -ln((CASE WHEN bt > 0 THEN {WEIGHT} ELSE 0 END) * t / greatest(bt, 1) + (CASE WHEN bt > 0 THEN {1 - WEIGHT} ELSE 1 END) * (st + 1) / (nt + v - 1)) AS lt
  FROM pair JOIN bef USING (a) JOIN one USING (w), tot),
mean AS (SELECT doc_id, count(*) AS n, avg(lt) AS lt, avg(lf) AS lf FROM bi JOIN loss USING (a, w) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_tokens, round(lt, 6) AS target_loss, round(lf, 6) AS background_loss, round(lt - lf, 6) AS score
FROM doc LEFT JOIN mean USING (doc_id)
"""
