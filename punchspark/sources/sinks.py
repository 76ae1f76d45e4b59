"""Sinks: punch append (S6), CSV report (S7), audit lines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punchspark.functions.text import csv_cell
from punchspark.policy import REPORT_CSV_HEADER

PUNCH_COLUMNS = ("EmployeeNo", "PunchDateTime", "DeviceName", "AreaName", "Status")


def append_punches(df: DataFrame, path: str, load: str | None = None) -> None:
    """Bulk append, partitioned by punch date (date filters prune partitions) and load.

    A load that is written again under its own name replaces itself, so a replay adds nothing.
    LogID is a hash of (load, ID, time), which ingestion leaves unique within a load: it is the
    same on a replay and settles the order of punches at one instant, though not by arrival.
    Rows are rebalanced by date first: about one file per date, hot dates split.
    """
    load = load or f"load-{uuid.uuid4().hex}"
    (
        df.select(F.xxhash64(F.lit(load), "EmployeeNo", "PunchDateTime").alias("LogID"), *PUNCH_COLUMNS)
        .withColumns({"punch_date": F.to_date("PunchDateTime"), "load": F.lit(load)})
        .hint("rebalance", "punch_date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("punch_date", "load")
        .parquet(path)
    )


REPORT_FIELDS = ("EmployeeID", "FirstName", "LastName", "Department", "Date", "Weekday", "FirstIn", "LastOut", "TotalHours", "Status")


def report_csv_frame(report_b: DataFrame) -> DataFrame:
    """The 10 CSV columns of a report-B frame, renamed to the CSV header."""
    return report_b.select(*[F.col(src).cast("string").alias(dst) for src, dst in zip(REPORT_FIELDS, REPORT_CSV_HEADER)])


def report_csv_lines(report_b: DataFrame) -> DataFrame:
    """S7/F8 as text: one CSV line per record, every cell quoted."""
    frame = report_csv_frame(report_b)
    return frame.select(F.concat_ws(",", *[csv_cell(F.col(f"`{c}`")) for c in frame.columns]).alias("line"))


def write_report_csv(report_b: DataFrame, path: str) -> None:
    """Every value double-quoted, '"' doubled, null → "" (F8 cell escaping via writer options).
    (Spark also quotes the header.)"""
    (
        report_csv_frame(report_b)
        .write.mode("errorifexists")
        .option("header", True)
        .option("quoteAll", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("nullValue", "")
        .option("lineSep", "\n")
        .csv(path)
    )


def export_audit_lines(events: DataFrame) -> DataFrame:
    """S8 export lines from (ts, name, username, format, filters map/struct)."""
    return events.select(
        F.format_string(
            "[%s] USER: %s (ADID: %s) | ACTION: Export %s | FILTERS: %s",
            F.col("ts"),
            F.col("name"),
            F.col("username"),
            F.upper(F.col("format")),
            F.to_json(F.col("filters")),
        ).alias("value")
    )


def session_audit_lines(events: DataFrame) -> DataFrame:
    """S8 session lines from (ts, action, user_id, name, role, status)."""
    base = F.format_string(
        "[%s] ACTION: %s | User ID: %s | Name: %s | Role: %s",
        F.col("ts"),
        F.col("action"),
        F.col("user_id"),
        F.col("name"),
        F.col("role"),
    )
    tail = F.when(F.coalesce(F.col("status"), F.lit("")) != "", F.concat(F.lit(" | Status: "), F.col("status")))
    return events.select(F.concat(base, F.coalesce(tail, F.lit(""))).alias("value"))


def append_audit(lines: DataFrame, path: str) -> None:
    """Append-only text sink."""
    lines.write.mode("append").text(path)
