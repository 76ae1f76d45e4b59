"""Punch ingestion (P10-P16): facility filter, time parse, in-file dedup, labels, metrics.

The dedup is a group-by on (upload, resolved ID, timestamp) keeping the first
row by file order via ``min_by`` — a partial aggregate, so a hot key (thousands of
'NOT PROVIDED' punches in one minute) is combined map-side. The same grouped
frame yields the stored rows and the counters, so the upload is read once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punchspark import policy as P
from punchspark.functions.dtparse import with_punch_datetime
from punchspark.functions.text import js_trim
from punchspark.operators.identity import punch_cells, resolve_identity


def exclude_facilities(df: DataFrame, facilities: tuple[str, ...] = P.INTERNAL_FACILITIES) -> DataFrame:
    """P10: flag (not yet drop) rows at internal doors; device name trimmed, exact match."""
    dev = js_trim(F.col("device_cell"))
    return df.withColumn("DeviceName", dev).withColumn("facility", dev.isin(*facilities))


def parse_times(df: DataFrame, strict_serial: bool = False) -> DataFrame:
    """P11/P12 on the date and time cells."""
    return with_punch_datetime(df, "date_cell", "time_cell", "PunchDateTime", strict_serial)


def dedup_groups(df: DataFrame) -> DataFrame:
    """P14 core: one row per (upload, ID, time, dropped) with the first row and the counts."""
    dropped = F.col("facility") | F.col("PunchDateTime").isNull()
    first = F.struct(
        F.col("row_ord"),
        F.col("DeviceName"),
        js_trim(F.col("area_cell")).alias("AreaName"),
        F.col("unauthorized"),
        F.col("match_method"),
    )
    return df.groupBy("upload_id", "EmployeeNo", "PunchDateTime", dropped.alias("dropped")).agg(
        F.min_by(first, F.col("row_ord")).alias("first"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("unauthorized")).alias("n_unauth"),
    )


def stored_punches(groups: DataFrame) -> DataFrame:
    """Rows to append; Status 'Unauthorized Entry' or null; blank device/area → null."""
    return groups.where(~F.col("dropped")).select(
        "upload_id",
        "EmployeeNo",
        "PunchDateTime",
        F.when(F.col("first.DeviceName") != "", F.col("first.DeviceName")).alias("DeviceName"),
        F.when(F.col("first.AreaName") != "", F.col("first.AreaName")).alias("AreaName"),
        F.when(F.col("first.unauthorized"), F.lit(P.UNAUTHORIZED)).alias("Status"),
        F.col("first.match_method").alias("match_method"),
    )


def ingest_metrics(groups: DataFrame) -> DataFrame:
    """Imported, skipped duplicates, unauthorized (counted before facility/parse/dedup drops)."""
    kept = ~F.col("dropped")
    return groups.agg(
        F.count_if(kept).alias("importedRows"),
        F.coalesce(F.sum(F.when(kept, F.col("n") - 1)), F.lit(0)).cast("bigint").alias("skippedDuplicates"),
        F.lit(0).cast("bigint").alias("autoProvisionedUsers"),
        F.lit(0).cast("bigint").alias("autoProvisionedDepartments"),
        F.coalesce(F.sum("n_unauth"), F.lit(0)).cast("bigint").alias("unauthorizedRecords"),
    )


@dataclass
class IngestResult:
    groups: DataFrame

    @property
    def punches(self) -> DataFrame:
        return stored_punches(self.groups)

    @property
    def metrics(self) -> DataFrame:
        return ingest_metrics(self.groups)


def ingest_punch_upload(
    upload: DataFrame,
    users: DataFrame,
    facilities: tuple[str, ...] = P.INTERNAL_FACILITIES,
    loose: bool = True,
    strict_serial: bool = False,
) -> IngestResult:
    """Resolve identity → facility filter → parse time → dedup → label (fixed order)."""
    cells = punch_cells(upload)
    resolved = resolve_identity(cells, users, loose)
    parsed = parse_times(exclude_facilities(resolved, facilities), strict_serial)
    return IngestResult(dedup_groups(parsed))
