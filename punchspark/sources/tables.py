"""Engine tables (S3): schemas, scans and versioned writes.

Tables are Parquet directories under a warehouse folder:
  departments/  users/  punches/ (partitioned by punch_date)
Rewrites (roster sync, user edits) write a new version directory and never
overwrite a path that is being read.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import types as T

from punchspark.sources.uploads import with_missing_columns

DEPARTMENTS_SCHEMA = T.StructType(
    [T.StructField("DepartmentID", T.IntegerType(), False), T.StructField("DepartmentName", T.StringType())]
)
USERS_SCHEMA = T.StructType(
    [
        T.StructField("UserID", T.IntegerType()),
        T.StructField("EmployeeNo", T.StringType()),
        T.StructField("FirstName", T.StringType()),
        T.StructField("LastName", T.StringType()),
        T.StructField("DepartmentID", T.IntegerType()),
        T.StructField("Role", T.StringType()),
        T.StructField("EmpType", T.StringType()),
        T.StructField("IsActive", T.BooleanType()),
    ]
)
PUNCHES_SCHEMA = T.StructType(
    [
        T.StructField("LogID", T.LongType()),
        T.StructField("EmployeeNo", T.StringType()),
        T.StructField("PunchDateTime", T.TimestampNTZType()),
        T.StructField("DeviceName", T.StringType()),
        T.StructField("AreaName", T.StringType()),
        T.StructField("Status", T.StringType()),
    ]
)


def _pointer(warehouse: str, name: str) -> str:
    return f"{warehouse.rstrip('/')}/{name}/_VERSIONS"


def table_path(spark: SparkSession, warehouse: str, name: str) -> str:
    """Current version of a table: the newest of its pointers, or the folder itself if it has none."""
    base = f"{warehouse.rstrip('/')}/{name}"
    try:
        newest = spark.read.text(_pointer(warehouse, name)).agg({"value": "max"}).first()[0]
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        newest = None  # an unversioned table
    return f"{base}/{newest.split()[1]}" if newest else base


def read_table(spark: SparkSession, warehouse: str, name: str, schema: T.StructType) -> DataFrame:
    """The table under its declared schema: columns that old files lack are null, and no file footer is read to plan."""
    return with_missing_columns(spark.read.schema(schema).parquet(table_path(spark, warehouse, name)), schema)


def departments(spark: SparkSession, warehouse: str) -> DataFrame:
    return read_table(spark, warehouse, "departments", DEPARTMENTS_SCHEMA)


def users(spark: SparkSession, warehouse: str) -> DataFrame:
    return read_table(spark, warehouse, "users", USERS_SCHEMA)


def punches(spark: SparkSession, warehouse: str) -> DataFrame:
    return read_table(spark, warehouse, "punches", PUNCHES_SCHEMA)


def write_new_version(df: DataFrame, warehouse: str, name: str) -> str:
    """Write ``df`` as a new version folder, then point the table at it.

    Readers of the previous version are never disturbed (its folder is kept). Pointers
    are lines (time, version) that are only ever added, so there is a current version at
    any moment; they are written through Spark, so any cluster file system works.
    """
    base = f"{warehouse.rstrip('/')}/{name}"
    version = f"v-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(f"{base}/{version}")
    spark = df.sparkSession
    spark.createDataFrame([(f"{time.time_ns():020d} {version}",)], "value string").coalesce(1).write.mode("append").text(_pointer(warehouse, name))
    return f"{base}/{version}"
