"""Exact dedup by content sort.

Texts are normalised (six white-space characters deleted), range-partitioned by sampled
splitters and sorted, so that equal texts become neighbours; each is compared in full
with the one before it. The sort key is (first bytes of the normalised text, its SHA-256,
id): a splitter is then small however long the texts are, and a group of copies too large
for one partition is cut by id and spread over as many as it needs. Groups that cross a
partition border are put together again by comparing the border texts in full.

Defined results: a null text counts as empty; all empty texts are one group. Of a group
the row with the most code points in the original text stays, then the smallest id (a null
id last), then any one of rows that agree in both. Every input row gets an output row.
Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punchspark.llm.common import blocks, checkpointed, keep_rows

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
PREFIX_CHARS = 32


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in blocks(batches, "text"):
        texts = [t or "" for t in part.column("text").to_pylist()]
        raw = [t.encode() for t in texts]
        norm = [b.translate(None, SPACES) for b in raw]
        yield pa.RecordBatch.from_arrays(
            [
                part.column("id"),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(b).hexdigest() for b in norm], pa.string()),
                pa.array([hashlib.sha256(b).hexdigest() for b in raw], pa.string()),
                pa.array(part.column("text").is_null()),
                pa.array([b.decode() for b in norm], pa.string()),
            ],
            ["id", "chars", "sha", "raw_sha", "was_null", "norm"],
        )


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run numbers of equal neighbours, and the texts of the first and the last run (kind 1)."""
    pid, row, run, first, last = TaskContext.get().partitionId(), 0, -1, None, None
    names = ["kind", "pid", "row", "run", "id", "chars", "sha", "raw_sha", "was_null", "edge"]
    for part in blocks(batches, "norm"):
        runs = []
        for text in part.column("norm").to_pylist():
            if run < 0 or text != last:
                run += 1
                first = text if run == 0 else first
                last = text
            runs.append(run)
        n = part.num_rows
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([0] * n, pa.int32()),
                pa.array([pid] * n, pa.int32()),
                pa.array(range(row, row + n), pa.int64()),
                pa.array(runs, pa.int64()),
                *(part.column(c) for c in ("id", "chars", "sha", "raw_sha", "was_null")),
                pa.nulls(n, pa.string()),
            ],
            names,
        )
        row += n
    if run >= 0:
        edges = [(0, first), (run, last)] if run else [(0, first)]
        n = len(edges)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([1] * n, pa.int32()),
                pa.array([pid] * n, pa.int32()),
                pa.array([-1] * n, pa.int64()),
                pa.array([e[0] for e in edges], pa.int64()),
                pa.nulls(n, pa.int64()),
                pa.nulls(n, pa.int64()),
                pa.nulls(n, pa.string()),
                pa.nulls(n, pa.string()),
                pa.nulls(n, pa.bool_()),
                pa.array([e[1] for e in edges], pa.string()),
            ],
            names,
        )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, and raw_sha256 (null for a null text)."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = rows.mapInArrow(_normalise, "id long, chars long, sha string, raw_sha string, was_null boolean, norm string")
    order = [F.substring("norm", 1, PREFIX_CHARS), F.col("sha"), F.col("id")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    done = checkpointed(
        ranged.mapInArrow(
            _neighbours,
            "kind int, pid int, row long, run long, id long, chars long, sha string, raw_sha string, was_null boolean, edge string",
        )
    )
    rows = done.where("kind = 0").drop("kind", "edge")
    runs = rows.groupBy("pid", "run").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct((-F.col("chars")).alias("less"), F.col("id").isNull().alias("no_id"), "id", "pid", "row")).alias("best"),
    )
    # runs at partition borders: equal border texts, compared in full by the grouping, are one group
    edges = done.where("kind = 1").select("pid", "run", "edge")
    whole = edges.groupBy("edge").agg(F.min(F.struct("pid", "run")).alias("group"))
    joined = edges.join(whole, "edge").select("pid", "run", "group").distinct()
    runs = runs.join(joined, ["pid", "run"], "left").withColumn("group", F.coalesce("group", F.struct("pid", "run")))
    groups = runs.groupBy("group").agg(F.sum("n").alias("group_size"), F.min("best").alias("best"))
    per_run = runs.select("pid", "run", "group").join(groups, "group").drop("group")
    return rows.join(per_run, ["pid", "run"]).select(
        "id",
        F.col("best.id").alias("keep_id"),
        "group_size",
        ((F.col("best.pid") == F.col("pid")) & (F.col("best.row") == F.col("row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        F.when(~F.col("was_null"), F.col("raw_sha")).alias("raw_sha256"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = exact_dedup(docs).where("kept").select(F.col("id").alias("__id"), F.col("raw_sha256").alias("__digest"))
    return keep_rows(docs, kept)
