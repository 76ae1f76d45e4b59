"""Small builders for test frames (engine-table shapes)."""

import datetime as dt

from pyspark.sql import functions as F

from punchspark.sources.tables import DEPARTMENTS_SCHEMA, PUNCHES_SCHEMA, USERS_SCHEMA


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def users_df(spark, rows):
    """rows: (UserID, EmployeeNo, FirstName, LastName, DepartmentID, Role, EmpType, IsActive)."""
    return spark.createDataFrame(rows, USERS_SCHEMA)


def depts_df(spark, rows):
    return spark.createDataFrame(rows, DEPARTMENTS_SCHEMA)


def punches_df(spark, rows):
    """rows: (LogID, EmployeeNo, 'yyyy-mm-dd hh:mm:ss', Device, Area, Status)."""
    data = [(r[0], r[1], ts(r[2]), r[3], r[4], r[5]) for r in rows]
    return spark.createDataFrame(data, PUNCHES_SCHEMA)


def upload_df(spark, header, rows, upload_id="u1"):
    """An all-string upload with reference header names and row order."""
    cols = list(header)
    df = spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"`{c}` string" for c in cols) or "x string")
    df = df.withColumn("__i", F.monotonically_increasing_id())
    return df.select(
        *[F.col(f"`{c}`") for c in cols],
        F.lit(upload_id).alias("upload_id"),
        F.struct(F.lit(0).cast("bigint").alias("blk"), F.col("__i").alias("rec")).alias("row_ord"),
    )


def rows_by(df, key):
    return {r[key]: r.asDict() for r in df.collect()}
