"""File-stream ingestion of punch uploads.

Uploads arrive one after another in an input folder. Without a header layout, files are
streamed as lines, and each batch, which has its files whole, keys their records by their own
headers, whatever the order or names of columns. With one, a streaming CSV source reads
columns by position. Each micro-batch runs
the same ingestion plan as a batch upload (identity → facility → parse → dedup
within the file → label) against the roster read for that batch, appends the
punches (partitioned by date) and the counters. ``trigger(availableNow=True)``
processes what is there and stops; progress lives in the checkpoint folder, so a
restarted job resumes from the last committed batch. Lost executors are covered by
Spark's task retry and output commit protocol. A batch is written as a load named after
its files, which replaces itself, so a batch that is replayed after a crash adds nothing.
A file whose header does not match a given layout fails the stream: columns are then read by position.

With ``cross_file_dedup`` a punch (resolved ID, time) that is stored already, or comes
twice in a batch, is not stored again, however late it arrives. A batch reads the stored
punches of its own dates only.
"""

from __future__ import annotations

import copy
import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from punchspark.operators.ingest import ingest_punch_upload
from punchspark.sources.sinks import append_punches
from punchspark.sources.tables import PUNCHES_SCHEMA
from punchspark.sources.uploads import CSV_GLOB, keyed_by_header, records_of_lines


def layout_schema(header: list[str]) -> T.StructType:
    return T.StructType([T.StructField(h, T.StringType()) for h in header])


def punch_file_stream(spark: SparkSession, input_dir: str, header: list[str], max_files_per_trigger: int = 100) -> DataFrame:
    """Streaming rows of one header layout with upload_id and row order."""
    raw = (
        spark.readStream.schema(layout_schema(header))
        .option("header", True)
        .option("enforceSchema", False)
        .option("escape", '"')
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .csv(input_dir)
    )
    return raw.select("*", F.col("_metadata.file_path").alias("upload_id"), F.col("_metadata.file_block_start").alias("__blk"))


def punch_line_stream(spark: SparkSession, input_dir: str, max_files_per_trigger: int = 100) -> DataFrame:
    """Streaming lines of CSV files of any header layouts."""
    raw = spark.readStream.option("pathGlobFilter", CSV_GLOB).option("maxFilesPerTrigger", max_files_per_trigger).text(input_dir)
    return raw.select("value", F.col("_metadata.file_path").alias("upload_id"), F.col("_metadata.file_block_start").alias("__blk"))


def with_batch_row_order(batch: DataFrame) -> DataFrame:
    """Row order inside a micro-batch (position ids are not allowed on the stream itself)."""
    return batch.withColumn("row_ord", F.struct(F.col("__blk").alias("blk"), F.monotonically_increasing_id().alias("rec"))).drop("__blk")


PRUNE_DATES = 1000
"""Dates of a batch that are named to the scan one by one; beyond, it gets the first and the last."""


def stored_on_dates_of(punches: DataFrame, stored: DataFrame) -> DataFrame:
    """The stored punches on the dates that a batch has, so that no other date's files are read."""
    days = punches.select(F.to_date("PunchDateTime").alias("day")).where("day is not null").distinct()
    some = [r.day for r in days.limit(PRUNE_DATES + 1).collect()]
    if len(some) <= PRUNE_DATES:
        return stored.where(F.col("punch_date").isin(some)) if some else stored.where("false")
    ends = days.agg(F.min("day").alias("first"), F.max("day").alias("last")).first()
    return stored.where(F.col("punch_date").between(ends.first, ends.last))


def new_punches(punches: DataFrame, path: str, load: str) -> DataFrame:
    """Punches of a batch whose (EmployeeNo, PunchDateTime) no other load has stored, once each.

    Late punches are compared with their own dates like any others; of the stored ones only the
    batch's dates are read, and the join is on the date too.
    """
    keys = ["EmployeeNo", "PunchDateTime"]
    fresh = punches.dropDuplicates(keys).withColumn("punch_date", F.to_date("PunchDateTime"))
    schema = copy.deepcopy(PUNCHES_SCHEMA)
    for name, kind in (("punch_date", "date"), ("load", "string")):
        schema = schema if name in schema.names else schema.add(name, kind)
    try:
        stored = punches.sparkSession.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return fresh.drop("punch_date")
    others = stored_on_dates_of(fresh, stored).where(F.col("load") != load).select(*keys, "punch_date")
    return fresh.join(others, [*keys, "punch_date"], "left_anti").drop("punch_date")


def load_name(batch: DataFrame) -> str:
    """A name made from the batch's files, of which there are at most ``max_files_per_trigger``."""
    files = sorted(r[0] for r in batch.select("upload_id").distinct().collect())
    return f"stream-{hashlib.md5(' '.join(files).encode()).hexdigest()}"


def start_punch_stream(
    spark: SparkSession,
    input_dir: str,
    header: list[str] | None,
    users_loader: Callable[[SparkSession], DataFrame],
    punches_path: str,
    metrics_path: str,
    checkpoint_dir: str,
    available_now: bool = True,
    cross_file_dedup: bool = False,
):
    """Start the stream; returns the StreamingQuery. Without ``header`` every file goes by its own."""
    stream = punch_line_stream(spark, input_dir) if header is None else punch_file_stream(spark, input_dir, header)

    def run_batch(batch: DataFrame, epoch_id: int) -> None:
        load = load_name(batch)
        rows = with_batch_row_order(batch)
        upload = keyed_by_header(records_of_lines(rows)) if header is None else rows  # a file comes whole in one batch
        result = ingest_punch_upload(upload, users_loader(batch.sparkSession))
        groups = result.groups.persist()
        try:
            punches = result.punches.drop("match_method")
            append_punches(new_punches(punches, punches_path, load) if cross_file_dedup else punches, punches_path, load)
            result.metrics.withColumn("epoch", F.lit(epoch_id)).write.mode("overwrite").parquet(f"{metrics_path}/load={load}")
        finally:
            groups.unpersist()

    writer = stream.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
