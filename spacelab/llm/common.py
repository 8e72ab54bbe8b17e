"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.storage import stored as written  # noqa: F401  the operators take it from here

#: Rows whose crc32(doc_id as text) leaves this remainder are never learnt from.
HELD_OUT_FOLDS = 5


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that an operator reads, under fixed names; other columns cannot clash."""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def id_type(docs: DataFrame, id_col: str) -> T.DataType:
    return docs.schema[id_col].dataType


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a string column; nulls stay None."""
    return column.cast(pa.binary()).to_pylist()


def decoded(column: pa.Array | pa.ChunkedArray) -> list[str | None]:
    """Texts of a string column; bytes that are not UTF-8 become replacement characters."""
    return [None if b is None else b.decode("utf-8", "replace") for b in text_bytes(column)]


def portions(batch: pa.RecordBatch, text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of whole rows with about ``limit`` bytes of text, so that work arrays stay small."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


_BLANK = re.compile(rb"[ \t-\r]")
PIECE = 1 << 20


def pieces(text: bytes, size: int | None = None) -> Iterator[bytes]:
    """Cut a text at ASCII white space into runs of about ``size`` bytes; no word is cut, so a long text needs no long list."""
    size, at = size or PIECE, 0
    while at < len(text):
        found = _BLANK.search(text, at + size) if at + size < len(text) else None
        cut = found.end() if found else len(text)
        yield text[at:cut] if at or cut < len(text) else text
        at = cut


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; gives back at its end what the allocators keep, since a worker lives on between tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def keep_rows(docs: DataFrame, text_col: str, wanted: Callable[[pa.RecordBatch], list[bool]]) -> DataFrame:
    """The rows that ``wanted`` chooses, with the columns and schema of ``docs`` unchanged."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [f"c{i}" for i in range(batch.num_columns)]
            plain = pa.RecordBatch.from_arrays(batch.columns, names=names)
            for part in portions(plain, names[at]):
                mask = wanted(pa.RecordBatch.from_arrays([part.column(at)], names=["text"]))
                kept = part.filter(pa.array(mask, pa.bool_()))
                if kept.num_rows:
                    yield pa.RecordBatch.from_arrays(kept.columns, schema=batch.schema)

    return docs.mapInArrow(lean(run), docs.schema)


def held_out(id_col: str):
    """True where crc32(doc_id as text) mod 5 is 0.  A null id has no text; it counts as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % HELD_OUT_FOLDS == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, target: str, bound: int) -> DataFrame:
    """(id, text, label) of at most ``bound`` labelled ids outside the held-out fold that have a document, of any length.

    Rows are ranked by a hash of their id, so the same rows come from the same tables at every partitioning.
    Conflicting or repeated labels of one id become one row, with the larger label; null labels are left out.
    """
    spark = docs.sparkSession
    every = keyed_text(docs, "doc_id", "text")
    chosen = (
        labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col(target).cast("int")).alias("label"))
        .join(every.select("id").hint("merge"), "id", "left_semi")  # ids without a document must not use up the bound
        .orderBy(F.xxhash64("id"), "id").limit(bound)
    )
    rows = [(r["id"], r["label"]) for r in chosen.collect()]  # bound rows at most
    table = spark.createDataFrame(rows, T.StructType([T.StructField("id", labels.schema["doc_id"].dataType), T.StructField("label", T.IntegerType())]))
    return every.join(F.broadcast(table), "id").select("id", "text", "label")
