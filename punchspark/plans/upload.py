"""End-to-end upload plans: punch files → punches table, roster files → users/departments."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punchspark.operators.common import checkpointed
from punchspark.operators.ingest import IngestResult, ingest_punch_upload
from punchspark.operators.roster import roster_rows, sync_roster_rows
from punchspark.sources import sinks, tables, uploads
from punchspark.sources.workbook import read_workbooks


def upload_frames(spark: SparkSession, path: str, multi_line: bool = False) -> list[DataFrame]:
    """The CSV uploads and the workbooks under ``path``, each a long frame.

    Listing goes through Spark, so ``path`` may be on any Hadoop file system. A file that is
    neither is an error, and so is a folder without uploads.
    """
    kind = F.lower(F.regexp_extract("upload_id", r"\.([^./]+)$", 1))
    kinds = {r.kind: r.one for r in uploads.files_under(spark, path).groupBy(kind.alias("kind")).agg(F.min("upload_id").alias("one")).collect()}
    other = [one for kind, one in kinds.items() if kind not in ("csv", "xlsx")]
    if other or not kinds:
        raise ValueError(f"not an upload (.csv or .xlsx): {other[0]}" if other else f"no uploads under {path}")
    frames = [uploads.read_csv_uploads(spark, path, multi_line)] if "csv" in kinds else []
    return frames + ([read_workbooks(spark, path)] if "xlsx" in kinds else [])


def load_names(spark: SparkSession, path: str) -> dict[str, str]:
    """A name for the load of each kind of file under ``path``, made from the files' names, sizes and times of change.

    So an upload that is run again, after a failure halfway or by mistake, replaces what it has stored.
    """
    seen = spark.read.format("binaryFile").load(path).select("_metadata.*")
    kind = F.lower(F.regexp_extract("file_path", r"\.([^./]+)$", 1))
    mark = F.xxhash64("file_path", "file_size", F.col("file_modification_time").cast("string"))
    rows = seen.groupBy(kind.alias("kind")).agg(F.bit_xor(mark).alias("mark"), F.count(F.lit(1)).alias("n")).collect()
    return {r.kind: f"{r.kind}-{r.n}-{r.mark & (2**64 - 1):016x}" for r in rows}


def ingest_punch_files(spark: SparkSession, path: str, warehouse: str, multi_line: bool = False) -> DataFrame:
    """Ingest every upload under ``path`` against the current roster; append the punches.

    Returns the counters per kind of upload (one row each). All kinds are read through before any
    is stored, and each is stored as a load named after its files.
    """
    users = tables.users(spark, warehouse)
    names = load_names(spark, path)
    frames = upload_frames(spark, path, multi_line)
    results = [IngestResult(checkpointed(ingest_punch_upload(f, users).groups)) for f in frames]  # one pass over each, lineage cut
    for kind, done in zip([k for k in ("csv", "xlsx") if k in names], results):
        sinks.append_punches(done.punches, os.path.join(warehouse, "punches"), names[kind])
    metrics = [done.metrics for done in results]
    out = metrics[0]
    for m in metrics[1:]:
        out = out.unionByName(m)
    return out


def sync_roster_files(spark: SparkSession, path: str, warehouse: str, multi_line: bool = False) -> DataFrame:
    """Sync roster uploads into new versions of the users and departments tables."""
    users, departments = tables.users(spark, warehouse), tables.departments(spark, warehouse)
    frames = upload_frames(spark, path, multi_line)
    # Headers are resolved per layout; files are then taken in path order, rows in file order.
    rows = None
    for f in frames:
        r = roster_rows(f).withColumn("row_ord", F.struct(F.col("upload_id").alias("file"), F.col("row_ord").alias("pos")))
        rows = r if rows is None else rows.unionByName(r)
    result = sync_roster_rows(users, departments, rows)
    metrics = checkpointed(result.metrics)
    tables.write_new_version(result.departments, warehouse, "departments")
    tables.write_new_version(result.users, warehouse, "users")
    return metrics.withColumn("uploads", F.lit(len(frames)))
