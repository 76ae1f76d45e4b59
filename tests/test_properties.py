"""Property checks: parse∘format is the identity, dedup is idempotent, partitioning does not matter."""

import datetime as dt
import random

from pyspark.sql import functions as F

from helpers import upload_df, users_df
from punchspark.functions.dtparse import with_punch_datetime
from punchspark.operators.ingest import ingest_punch_upload

LAYOUTS = [("yyyy-MM-dd", "HH:mm:ss"), ("dd-MM-yyyy", "H:mm:ss"), ("MM/dd/yyyy", "HH:mm:ss"), ("d MMM yyyy", "H:mm:ss")]


def test_parse_of_format_is_identity(spark):
    rnd = random.Random(7)
    base = dt.datetime(1990, 1, 1)
    stamps = [base + dt.timedelta(seconds=rnd.randrange(0, 60 * 365 * 86400)) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(stamps)], "i int, ts timestamp_ntz")
    for dfmt, tfmt in LAYOUTS:
        cells = df.select("i", "ts", F.date_format("ts", dfmt).alias("d"), F.date_format("ts", tfmt).alias("t"))
        bad = with_punch_datetime(cells, "d", "t", "back").where(F.col("back").isNull() | (F.col("back") != F.col("ts")))
        assert bad.count() == 0, (dfmt, bad.limit(3).collect())


def test_dedup_is_idempotent_and_partition_free(spark):
    header = ["Staff ID", "Date", "Time", "DeviceName", "AreaName"]
    rnd = random.Random(3)
    rows = [[rnd.choice(["E1", "E2", "E3", "", "0"]), "2026-05-25", f"{rnd.randrange(8, 19)}:{rnd.randrange(0, 3):02d}", "D", "A"] for _ in range(300)]
    users = users_df(spark, [(1, "E1", "A", "B", 1, "User", None, True), (2, "E2", "C", "D", 1, "User", None, True)])
    first = ingest_punch_upload(upload_df(spark, header, rows), users).punches
    once = sorted((r["EmployeeNo"], r["PunchDateTime"]) for r in first.collect())
    assert len(once) == len(set(once))
    again_rows = [[e, t.strftime("%Y-%m-%d"), t.strftime("%H:%M"), "D", "A"] for e, t in once]
    again = sorted((r["EmployeeNo"], r["PunchDateTime"]) for r in ingest_punch_upload(upload_df(spark, header, again_rows), users).punches.collect())
    # Re-ingesting the stored punches keeps every row (IDs are already resolved or kept as given).
    assert [x[1] for x in again] == [x[1] for x in once]
    spread = upload_df(spark, header, rows).repartition(5)
    other = sorted((r["EmployeeNo"], r["PunchDateTime"]) for r in ingest_punch_upload(spread, users).punches.collect())
    assert other == once
