"""Daily record A — the dashboard report.

Plan shape: punches are reduced to one row per (EmployeeNo, date) first
(partial + final hash aggregate, so the shuffle carries user-days, not punches),
and only then inner-joined with users and departments. Because EmployeeNo is
unique in users, grouping before the join gives the same groups as the
reference's join-then-group. User-side filters (department, employee search)
also become a semi-join on the punch side ahead of the aggregate.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punchspark.functions.text import like_escape
from punchspark.functions.timefmt import (
    cents_fixed2,
    cents_to_double,
    format_24h,
    half_up_ratio,
    hours_cents,
    minute_of_day,
    span_micros,
    weekday_name,
)
from punchspark.operators.common import broadcast_if_small
from punchspark import policy as P

RECORD_COLUMNS = ("EmployeeID", "Name", "Department", "EmpType", "Date", "Weekday", "FirstIn", "LastOut", "TotalHours", "Status")


def _to_date(v) -> dt.date | None:
    if v is None or v == "":
        return None
    return v if isinstance(v, dt.date) else dt.date.fromisoformat(str(v))


def punch_date_range(punches: DataFrame, start, end, ts_col: str = "PunchDateTime") -> DataFrame:
    """A3: inclusive on the punch date, written as a timestamp range so it reaches the scan."""
    s, e = _to_date(start), _to_date(end)
    if s is None or e is None:
        return punches
    lo = dt.datetime.combine(s, dt.time())
    hi = dt.datetime.combine(e + dt.timedelta(days=1), dt.time())
    ts = F.col(ts_col)
    # string literals: wall-clock bounds independent of any time zone
    cond = (ts >= F.lit(lo.isoformat(sep=" ")).cast("timestamp_ntz")) & (ts < F.lit(hi.isoformat(sep=" ")).cast("timestamp_ntz"))
    if "punch_date" in punches.columns:  # partition pruning on stored tables
        cond = cond & F.col("punch_date").between(F.lit(s), F.lit(e))
    return punches.where(cond)


def by_department(users: DataFrame, department_id) -> DataFrame:
    """A4: equality on DepartmentID unless empty/'All'."""
    if department_id in (None, "", "All"):
        return users
    return users.where(F.col("DepartmentID") == F.lit(int(department_id)))


def by_employee(users: DataFrame, text: str | None, raw: bool = False) -> DataFrame:
    """A5: case-insensitive substring on EmployeeNo, FirstName or LastName.

    ``raw=True`` keeps '%'/'_' in the text as wildcards (reference behaviour).
    """
    if text is None or text.strip() == "":
        return users
    t = text.strip()
    pattern = f"%{t if raw else like_escape(t)}%"
    cond = None
    for c in ("EmployeeNo", "FirstName", "LastName"):
        term = F.col(c).ilike(pattern)
        cond = term if cond is None else (cond | term)
    return users.where(F.coalesce(cond, F.lit(False)))


def punch_roster_join(punches: DataFrame, users: DataFrame, departments: DataFrame) -> DataFrame:
    """A1: row-level logs ⋈ users ⋈ departments (inner). No IsActive filter."""
    u = users.select("EmployeeNo", "FirstName", "LastName", "DepartmentID", "EmpType", "IsActive")
    d = broadcast_if_small(departments.select("DepartmentID", "DepartmentName"))
    return punches.join(broadcast_if_small(u), "EmployeeNo", "inner").join(d, "DepartmentID", "inner")


def active_punches(punches: DataFrame, users: DataFrame, departments: DataFrame) -> DataFrame:
    """A2: the documented active-only listing (7 columns)."""
    j = punch_roster_join(punches, users, departments).where(F.col("IsActive"))
    return j.select(
        "EmployeeNo",
        "FirstName",
        "LastName",
        F.col("DepartmentName"),
        "EmpType",
        F.to_date("PunchDateTime").alias("LogDate"),
        F.date_format("PunchDateTime", "HH:mm:ss").alias("LogTime"),
    )


def daily_first_last(
    punches: DataFrame,
    users: DataFrame,
    departments: DataFrame,
    start=None,
    end=None,
    department_id=None,
    employee: str | None = None,
    raw_like: bool = False,
) -> DataFrame:
    """A1+A3-A6: one row per employee-day with first and last punch."""
    p = punch_date_range(punches.select(*[c for c in ("EmployeeNo", "PunchDateTime", "punch_date") if c in punches.columns]), start, end)
    u = by_employee(by_department(users, department_id), employee, raw_like)
    u = u.select("EmployeeNo", "FirstName", "LastName", "DepartmentID", "EmpType")
    filtered_users = department_id not in (None, "", "All") or (employee or "").strip() != ""
    if filtered_users:
        p = p.join(broadcast_if_small(u.select("EmployeeNo")), "EmployeeNo", "left_semi")
    days = p.groupBy("EmployeeNo", F.to_date("PunchDateTime").alias("AttendanceDate")).agg(
        F.min("PunchDateTime").alias("first_in"), F.max("PunchDateTime").alias("last_out")
    )
    d = broadcast_if_small(departments.select("DepartmentID", F.col("DepartmentName").alias("Department")))
    return days.join(broadcast_if_small(u), "EmployeeNo", "inner").join(d, "DepartmentID", "inner")


def classify_a(days: DataFrame, pol: P.ShiftPolicy = P.POLICY_A) -> DataFrame:
    """Hours, status and presentation of each employee-day."""
    first, last = F.col("first_in"), F.col("last_out")
    single = first == last
    late = minute_of_day(first) > pol.late_after_minute
    early = minute_of_day(last) < pol.early_before_minute
    over = span_micros(first, last) > F.lit(int(pol.overtime_hours * 3_600_000_000))
    # Incomplete, then early/late combinations, then unrounded overtime
    status = (
        F.when(single, P.A_INCOMPLETE)
        .when(early & late, P.A_LATE_EARLY)
        .when(early, P.A_EARLY)
        .when(late, P.A_LATE_LATE)
        .when(over, P.A_OVERTIME)
        .otherwise(P.A_ONTIME)
    )
    cents = F.when(~single, hours_cents(first, last))
    name = F.concat(F.coalesce(F.col("FirstName"), F.lit("")), F.lit(" "), F.coalesce(F.col("LastName"), F.lit("")))
    return days.select(
        F.col("EmployeeNo").alias("EmployeeID"),
        F.when(name != "", name).otherwise(F.lit("Standard Employee")).alias("Name"),
        "Department",
        F.when(F.coalesce(F.col("EmpType"), F.lit("")) != "", F.col("EmpType")).otherwise(F.lit(P.A_DEFAULT_EMPTYPE)).alias("EmpType"),
        F.date_format("AttendanceDate", "yyyy-MM-dd").alias("Date"),
        weekday_name("AttendanceDate").alias("Weekday"),
        format_24h(first).alias("FirstIn"),
        F.when(single, F.lit(P.A_MISSING_CHECKOUT)).otherwise(format_24h(last)).alias("LastOut"),
        F.when(single, F.lit(P.A_NO_HOURS)).otherwise(cents_fixed2(cents)).alias("TotalHours"),
        status.alias("Status"),
        cents.alias("hours_cents"),
        cents_to_double(cents).alias("hours"),
        first.alias("first_in"),
        last.alias("last_out"),
    )


def by_status(records: DataFrame, status: str | None) -> DataFrame:
    """Exact equality after classification; 'All'/empty = no filter."""
    if status in (None, "", "All"):
        return records
    return records.where(F.col("Status") == F.lit(status))


def order_daily(records: DataFrame) -> DataFrame:
    """Date descending, EmployeeNo ascending."""
    return records.orderBy(F.col("Date").desc(), F.col("EmployeeID").asc())


def daily_attendance(
    punches: DataFrame,
    users: DataFrame,
    departments: DataFrame,
    start=None,
    end=None,
    department_id=None,
    employee: str | None = None,
    status: str | None = None,
    pol: P.ShiftPolicy = P.POLICY_A,
    raw_like: bool = False,
) -> DataFrame:
    """Report A records (unordered; apply ``order_daily`` for display). With ``raw_like``, % and _ in ``employee`` are wildcards."""
    days = daily_first_last(punches, users, departments, start, end, department_id, employee, raw_like)
    return by_status(classify_a(days, pol), status)


def status_distribution(records: DataFrame) -> DataFrame:
    """Counts of the five chart statuses, zero-filled, one pass, no join."""
    counts = records.agg(*[F.count_if(F.col("Status") == s).alias(f"c{i}") for i, s in enumerate(P.A_CHART_STATUSES)])
    stack_args = ", ".join(f"'{s}', c{i}" for i, s in enumerate(P.A_CHART_STATUSES))
    return counts.selectExpr(f"stack({len(P.A_CHART_STATUSES)}, {stack_args}) AS (Status, Count)")


def daily_trend(records: DataFrame) -> DataFrame:
    """Per date, mean of the 2-decimal hours of complete records, half-up to 2 decimals."""
    agg = (
        records.where(F.col("Status") != P.A_INCOMPLETE)
        .groupBy(F.col("Date").alias("date"))
        .agg(F.sum("hours_cents").alias("s"), F.count("hours_cents").alias("n"))
    )
    avg = F.when(F.col("n") > 0, half_up_ratio(F.col("s"), F.col("n"))).otherwise(F.lit(0).cast("bigint"))
    return agg.select("date", cents_to_double(avg).alias("avgHours"))
