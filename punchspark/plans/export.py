"""Export of report B in a format, with its audit line."""

from __future__ import annotations

import datetime as dt
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from punchspark.operators import report_b as B
from punchspark.sources import sinks

SUPPORTED = ("excel", "csv", "pdf")


class ExportError(ValueError):
    pass


def export_report(
    spark: SparkSession,
    punches: DataFrame,
    users: DataFrame,
    departments: DataFrame,
    fmt: str | None,
    out_dir: str,
    audit_path: str | None = None,
    user_name: str = "",
    username: str = "",
    **filters,
) -> dict:
    """'excel'/'csv' write the CSV report; 'pdf' only acknowledges (printed by the browser).

    Every accepted request appends one audit line (format upper-cased, the request's
    parameters as JSON). Each export has a folder of its own.
    """
    if not fmt:
        raise ExportError("Export format is required.")
    if audit_path:
        stamp = dt.datetime.now(dt.timezone.utc).astimezone(dt.timezone(dt.timedelta(hours=5, minutes=30)))
        event = spark.createDataFrame(
            [(stamp.strftime("%Y-%m-%d %H:%M:%S"), user_name, username, fmt, {"format": fmt} | {k: str(v) for k, v in filters.items() if v is not None})],
            "ts string, name string, username string, format string, filters map<string,string>",
        )
        sinks.append_audit(sinks.export_audit_lines(event), audit_path)
    if fmt in ("excel", "csv"):
        report = B.daily_report_b(
            punches,
            users,
            departments,
            from_date=filters.get("fromDate"),
            to_date=filters.get("toDate"),
            department=filters.get("department"),
            status=filters.get("status"),
            search=filters.get("search"),
        )
        path = os.path.join(out_dir, f"Attendance_Report_{dt.date.today().isoformat()}_{uuid.uuid4().hex[:12]}")
        sinks.write_report_csv(report, path)
        return {"success": True, "path": path}
    if fmt == "pdf":
        return {"success": True, "message": "PDF export operation logged successfully."}
    raise ExportError("Unsupported export format.")

