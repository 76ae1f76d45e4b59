"""Command line: the reference's user-facing operations as Spark jobs over a warehouse folder.

  python -m punchspark init       --warehouse W [--departments IT,HR,...]
  python -m punchspark roster     --warehouse W --input DIR        (roster uploads: CSV / .xlsx)
  python -m punchspark punches    --warehouse W --input DIR        (punch uploads: CSV / .xlsx)
  python -m punchspark dashboard  --warehouse W --out DIR [--start D --end D --department ID --employee TEXT [--wildcards] --status S]
  python -m punchspark export     --warehouse W --out DIR --format csv [--from D --to D --department NAME --status S --search TEXT]
  python -m punchspark departments --warehouse W
  python -m punchspark users      --warehouse W --action create|update|active --input requests.csv
  python -m punchspark stream     --warehouse W --input DIR [--header "Staff ID,Date,Time,DeviceName"]

The cluster's session settings (master, spark.checkpoint.dir, sizing) come from
spark-submit and are taken as they are. Uploads with quoted line breaks need --multi-line.
"""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _session() -> SparkSession:
    """The session as submitted: master, partitions and the like are never overridden."""
    return SparkSession.getActiveSession() or SparkSession.builder.appName("punchspark").getOrCreate()


def main(argv: list[str] | None = None) -> dict:
    ap = argparse.ArgumentParser(prog="punchspark")
    ap.add_argument("command", choices=["init", "roster", "punches", "dashboard", "export", "departments", "users", "stream"])
    ap.add_argument("--action", choices=["create", "update", "active"])
    ap.add_argument("--header")
    ap.add_argument("--warehouse", required=True)
    ap.add_argument("--input")
    ap.add_argument("--out")
    ap.add_argument("--departments", default="IT")
    ap.add_argument("--start")
    ap.add_argument("--end")
    ap.add_argument("--department")
    ap.add_argument("--employee")
    ap.add_argument("--wildcards", action="store_true", help="%% and _ in --employee stand for any text and any character")
    ap.add_argument("--status")
    ap.add_argument("--format", default="csv")
    ap.add_argument("--from", dest="from_date")
    ap.add_argument("--to", dest="to_date")
    ap.add_argument("--search")
    ap.add_argument("--multi-line", action="store_true")
    a = ap.parse_args(argv)
    spark = _session()

    from punchspark.operators import roster as R
    from punchspark.plans.dashboard import dashboard_bundle
    from punchspark.plans.export import export_report
    from punchspark.plans.upload import ingest_punch_files, sync_roster_files
    from punchspark.sources import tables, uploads
    from punchspark.sources.tables import DEPARTMENTS_SCHEMA, USERS_SCHEMA

    wh = a.warehouse
    if a.command == "init":
        names = [n.strip() for n in a.departments.split(",") if n.strip()]
        tables.write_new_version(spark.createDataFrame([(i + 1, n) for i, n in enumerate(names)], DEPARTMENTS_SCHEMA), wh, "departments")
        tables.write_new_version(spark.createDataFrame([], USERS_SCHEMA), wh, "users")
        return {"departments": len(names)}
    if a.command == "roster":
        return sync_roster_files(spark, a.input, wh, a.multi_line).first().asDict()
    if a.command == "punches":
        rows = ingest_punch_files(spark, a.input, wh, a.multi_line).collect()  # one counter row per upload layout
        keys = ("importedRows", "skippedDuplicates", "autoProvisionedUsers", "autoProvisionedDepartments", "unauthorizedRecords")
        return {k: int(sum(r[k] for r in rows)) for k in keys}
    if a.command == "users":
        # requests: one CSV row per request, in file order (columns as the admin API fields)
        req = uploads.read_csv_layout(spark, [a.input], a.multi_line).withColumn("req_ord", F.col("row_ord"))
        users = tables.users(spark, wh)
        if a.action == "create":
            new_users, rejects = R.create_users(users, req)
            tables.write_new_version(new_users, wh, "users")
            path = tables.write_new_version(rejects.drop("req_ord"), wh, "user_request_rejects")
            return {"rejects": path, "rejected": spark.read.parquet(path).count()}
        if a.action == "update":
            tables.write_new_version(R.update_users(users, req), wh, "users")
        else:
            tables.write_new_version(R.set_active(users, req.withColumn("isActive", F.col("isActive").cast("boolean"))), wh, "users")
        return {"action": a.action}
    if a.command == "stream":
        from punchspark.streaming.punch_stream import start_punch_stream

        q = start_punch_stream(
            spark,
            a.input,
            [h.strip() for h in a.header.split(",")] if a.header else None,
            lambda s: tables.users(s, wh),
            os.path.join(wh, "punches"),
            os.path.join(wh, "ingest_metrics"),
            os.path.join(wh, "_stream_checkpoint"),
        )
        q.awaitTermination()
        return {"stream": "done"}
    punches, users, departments = tables.punches(spark, wh), tables.users(spark, wh), tables.departments(spark, wh)
    if a.command == "departments":
        return {"departments": [r.asDict() for r in R.departments_list(departments).collect()]}  # a short list
    if a.command == "dashboard":
        d = dashboard_bundle(punches, users, departments, a.start, a.end, a.department, a.employee, a.status, raw_like=a.wildcards)
        try:
            for name, frame in (("records", d.records.drop("first_in", "last_out")), ("trend", d.trend), ("distribution", d.distribution), ("summary", d.summary), ("employees", d.employees)):
                frame.write.mode("overwrite").option("header", True).csv(os.path.join(a.out, name))
            return {"out": a.out, "records": d.records.count()}
        finally:
            d.release()
    filters = {"fromDate": a.from_date, "toDate": a.to_date, "department": a.department, "status": a.status, "search": a.search}
    return export_report(spark, punches, users, departments, a.format, a.out, os.path.join(wh, "audit"), **{k: v for k, v in filters.items() if v})


if __name__ == "__main__":
    print(json.dumps(main(), default=str))
