"""Shared helpers of the training-data operators: Arrow text handling, bounded blocks, checkpoints.

Inside a task, text is handled in blocks of bounded bytes (``blocks``), so the working
memory of a Python worker does not depend on the Arrow batch that Spark happens to send;
one block never holds less than one row, so a single very long text is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punchspark.session import ensure_checkpoint_dir

BLOCK_BYTES = 4 << 20
BLOCK_ROWS = 4096

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
"""Byte table that lower-cases A-Z and leaves every other byte as it is."""


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the cluster's shared folder (spark.checkpoint.dir) and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array, nulls as empty; offsets start at 0."""
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    offsets = np.frombuffer(arr.buffers()[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = arr.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def string_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Inverse of ``text_bytes`` for bytes that are valid UTF-8 at the offsets."""
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES, rows: int = BLOCK_ROWS) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of ``rows`` rows at most, whose ``column`` holds about ``limit`` bytes (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = text_bytes(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            end = min(max(end, start + 1), start + rows, batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def mapped_words(arr: pa.Array, table: bytes) -> tuple[pa.Array, np.ndarray]:
    """(words, row offsets into them): bytes are mapped by ``table``, then split on ASCII white space.

    The table may turn separators into spaces and change case; bytes of 128 and above
    must stay as they are, so the result is valid UTF-8. Null texts have no words.
    """
    data, offsets = text_bytes(arr)
    mapped = np.frombuffer(table, np.uint8)[data]
    lists = pc.ascii_split_whitespace(string_array(mapped, offsets))
    flat, bounds = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
    bounds = bounds - bounds[0]
    full = np.asarray(pc.not_equal(flat, ""), dtype=bool) if len(flat) else np.zeros(0, bool)
    if not full.all():
        kept = np.concatenate([[0], np.cumsum(full)])
        flat, bounds = flat.filter(pa.array(full)), kept[bounds]
    return flat, bounds


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Columns that identify a row by content: the id and a digest of the text (null differs from empty)."""
    return [F.col(id_col).alias("__id"), F.sha2(F.col(text_col).cast("binary"), 256).alias("__digest")]


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose (id, text digest) is among ``kept`` (__id, __digest), once each, with the columns of ``docs``.

    Rows that repeat both id and text collapse to one, which is what a deduplication asks for.
    """
    names = docs.columns
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), *row_key(id_col, text_col))
    right = kept.select(F.col("__id").alias("__i"), F.col("__digest").alias("__d")).distinct()
    same = F.col("__id").eqNullSafe(F.col("__i")) & F.col("__digest").eqNullSafe(F.col("__d"))
    return left.join(right, same, "left_semi").dropDuplicates(["__id", "__digest"]).select(*[F.col("__row").getField(c).alias(c) for c in names])
