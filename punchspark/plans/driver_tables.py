"""Mapping of the bundled test tables onto the engine's tables.

| engine table | from      | mapping |
| punches      | events    | EmployeeNo = user_id as text, PunchDateTime = ts, DeviceName = event_type, AreaName = props, LogID = event_id |
| users        | customer  | EmployeeNo = c_custkey as text, FirstName = '', LastName = c_name, DepartmentID = c_nationkey, EmpType = c_mktsegment, IsActive = c_acctbal >= 0 |
| departments  | nation    | DepartmentID = n_nationkey, DepartmentName = n_name |

Upload-shaped frames (all-string cells with the reference's header names) are
derived from the same tables so ingestion and roster sync run over whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from punchspark import policy as P


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def punches_from_events(events: DataFrame, employee: Column | None = None, status: Column | None = None) -> DataFrame:
    return events.select(
        F.col("event_id").alias("LogID"),
        (F.col("user_id").cast("string") if employee is None else employee).alias("EmployeeNo"),
        F.col("ts").alias("PunchDateTime"),
        F.col("event_type").alias("DeviceName"),
        F.col("props").alias("AreaName"),
        (F.lit(None).cast("string") if status is None else status).alias("Status"),
    )


def rough_punches_from_events(events: DataFrame) -> DataFrame:
    """Punches as a warehouse may hold them: null, blank, unknown and padded IDs, ties within
    the hour, unauthorized entries ('error' events)."""
    e = F.col("event_id")
    uid = F.col("user_id").cast("string")
    return punches_from_events(events.withColumn("rough_id", F.when(e % 17 == 0, None)
        .when(e % 19 == 0, F.lit("  ")).when(e % 23 == 0, F.concat(F.lit('q"'), uid))
        .when(e % 29 == 0, F.concat(F.lit(" "), uid, F.lit(" "))).otherwise(uid))
        .withColumn("ts", F.to_timestamp_ntz(F.date_format("ts", "yyyy-MM-dd HH:00:00"))),
        F.col("rough_id"), F.when(F.col("event_type") == "error", F.lit(P.UNAUTHORIZED)))


def users_from_customer(customer: DataFrame) -> DataFrame:
    return customer.select(
        (F.col("c_custkey") + 1).cast("int").alias("UserID"),
        F.col("c_custkey").cast("string").alias("EmployeeNo"),
        F.lit("").alias("FirstName"),
        F.col("c_name").alias("LastName"),
        F.col("c_nationkey").cast("int").alias("DepartmentID"),
        F.lit(P.DEFAULT_ROLE).alias("Role"),
        F.col("c_mktsegment").alias("EmpType"),
        (F.col("c_acctbal") >= 0).alias("IsActive"),
    )


def users_from_supplier(supplier: DataFrame) -> DataFrame:
    """A second, smaller staff table (the roster before a sync)."""
    return supplier.select(
        (F.col("s_suppkey") + 1).cast("int").alias("UserID"),
        F.col("s_suppkey").cast("string").alias("EmployeeNo"),
        F.lit("").alias("FirstName"),
        F.col("s_name").alias("LastName"),
        F.col("s_nationkey").cast("int").alias("DepartmentID"),
        F.lit(P.DEFAULT_ROLE).alias("Role"),
        F.lit(None).cast("string").alias("EmpType"),
        (F.col("s_acctbal") >= 0).alias("IsActive"),
    )


def departments_from_nation(nation: DataFrame) -> DataFrame:
    return nation.select(
        F.col("n_nationkey").cast("int").alias("DepartmentID"), F.col("n_name").alias("DepartmentName")
    )


def engine_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(punches, users, departments) over the test tables."""
    return (
        punches_from_events(table(spark, sf_dir, "events")),
        users_from_customer(table(spark, sf_dir, "customer")),
        departments_from_nation(table(spark, sf_dir, "nation")),
    )


# Badge devices per event type in the derived punch upload.
DEVICE_BY_EVENT = {
    "view": "MAIN GATE-IN",
    "click": "MAIN GATE-OUT",
    "purchase": "CAFETERIA-IN",
    "signup": "SERVER ROOM-IN",
    "error": "MAIN GATE-IN",
}


def punch_upload_from_events(events: DataFrame, part: DataFrame) -> DataFrame:
    """A facility-layout punch upload derived from every event.

    * 'error' events are unread cards: the reader reports the dummy ID '0', so the
      person is found by name;
    * the person's name is the two-word p_name of the part with p_partkey = user_id;
    * times carry minutes only (as many readers export), so two events of one person
      within a minute are duplicates;
    * device by event type (see DEVICE_BY_EVENT; 'signup' is an internal door).
    """
    names = part.select(
        F.col("p_partkey").alias("user_id"),
        F.element_at(F.split("p_name", " "), 1).alias("PersonFirstName"),
        F.element_at(F.split("p_name", " "), -1).alias("PersonLastName"),
    )
    device = F.create_map(*[x for k, v in DEVICE_BY_EVENT.items() for x in (F.lit(k), F.lit(v))])
    e = events.join(names, "user_id", "left")
    return e.select(
        F.col("event_id").cast("string").alias("S.No"),
        F.when(F.col("event_type") == "error", F.lit("0")).otherwise(F.col("user_id").cast("string")).alias("PersonNo"),
        F.coalesce(F.col("PersonFirstName"), F.lit("")).alias("PersonFirstName"),
        F.coalesce(F.col("PersonLastName"), F.lit("")).alias("PersonLastName"),
        F.date_format("ts", "dd-MM-yyyy").alias("DATE"),
        F.date_format("ts", "HH:mm").alias("TIME"),
        F.coalesce(F.element_at(device, F.col("event_type")), F.col("event_type")).alias("DeviceName"),
        F.col("props").alias("AreaName"),
        F.lit("events").alias("upload_id"),
        F.struct(F.lit(0).cast("bigint").alias("blk"), F.col("event_id").alias("rec")).alias("row_ord"),
    )


def named_roster(customer: DataFrame, part: DataFrame) -> DataFrame:
    """Users whose names are the two words of p_name (part with p_partkey = c_custkey)."""
    names = part.select(
        F.col("p_partkey").alias("c_custkey"),
        F.element_at(F.split("p_name", " "), 1).alias("fn"),
        F.element_at(F.split("p_name", " "), -1).alias("ln"),
    )
    base = users_from_customer(customer).withColumn("c_custkey", F.col("EmployeeNo").cast("bigint"))
    return base.join(names, "c_custkey", "left").select(
        "UserID",
        "EmployeeNo",
        F.coalesce(F.col("fn"), F.lit("")).alias("FirstName"),
        F.coalesce(F.col("ln"), F.col("LastName")).alias("LastName"),
        "DepartmentID",
        "Role",
        "EmpType",
        "IsActive",
    )


def roster_upload_from_customer(customer: DataFrame) -> DataFrame:
    """A unified-name roster upload: one row per customer, department = market segment."""
    return customer.select(
        F.col("c_custkey").cast("string").alias("Staff No."),
        F.col("c_name").alias("Name"),
        F.col("c_mktsegment").alias("Department"),
        F.when(F.col("c_acctbal") >= 0, F.lit("Permanent")).otherwise(F.lit("Contract")).alias("Emp.Type"),
        F.lit("customers").alias("upload_id"),
        F.struct(F.lit(0).cast("bigint").alias("blk"), F.col("c_custkey").alias("rec")).alias("row_ord"),
    )
