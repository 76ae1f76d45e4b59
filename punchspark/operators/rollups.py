"""Dashboard roll-ups over report-A records.

All are single aggregates or per-row expressions; nothing is brought to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punchspark import policy as P
from punchspark.functions.text import js_trim
from punchspark.functions.timefmt import cents_fixed2, cents_to_double, half_up_ratio, js_int_prefix, minute_of_day
from punchspark.operators.roster import dense_index


def summary_widgets(records: DataFrame) -> DataFrame:
    """Distinct employees, records, incomplete records, mean numeric hours ('0.00' if none)."""
    agg = records.agg(
        F.count_distinct("EmployeeID").alias("total_employees"),
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.upper(F.col("Status")) == P.A_INCOMPLETE.upper()).alias("incomplete"),
        F.sum("hours_cents").alias("s"),
        F.count("hours_cents").alias("n"),
    )
    avg = F.when(F.col("n") > 0, cents_fixed2(half_up_ratio(F.col("s"), F.col("n")))).otherwise(F.lit("0.00"))
    return agg.select("total_employees", "records", "incomplete", avg.alias("avg_hours"))


def _clock_minutes(text: Column) -> Column:
    """'HH:mm:ss' → minutes; null for '-', 'Missing ...' or fewer than two parts."""
    parts = F.split(F.coalesce(text, F.lit("")), ":")
    ok = (F.coalesce(text, F.lit("")) != "") & (text != "-") & ~F.lower(text).contains("missing") & (F.size(parts) >= 2)
    return F.when(ok, js_int_prefix(parts[0]) * 60 + js_int_prefix(parts[1]))


def in_band_of(m: Column) -> Column:
    out = None
    for lo, hi, label in P.IN_TIME_BANDS:
        cond = (m >= lo) if hi is None else ((m >= lo) & (m <= hi))
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(F.lit(""))


def out_band_of(m: Column) -> Column:
    out = None
    for lo, hi, label in P.OUT_TIME_BANDS:
        if lo is None:
            cond = m <= hi
        elif hi is None:
            cond = m >= lo
        else:
            cond = (m >= lo) & (m <= hi)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(F.lit(""))


def hours_band(hours: Column, incomplete: Column) -> Column:
    """Hours colour band; 'Incomplete' when there are no hours."""
    out = F.when(incomplete, F.lit("Incomplete"))
    for cut, label in P.HOURS_BANDS:
        out = out.when(hours >= cut, label)
    return out.otherwise(F.lit("danger"))


def status_severity(status: Column) -> Column:
    """Badge severity per status."""
    up = F.upper(F.coalesce(status, F.lit("")))
    out = None
    for s, label in P.STATUS_SEVERITY.items():
        out = F.when(up == s, label) if out is None else out.when(up == s, label)
    return out.otherwise(F.lit("secondary"))


def time_bands(records: DataFrame) -> DataFrame:
    """D2-D5 on every record, plus the incomplete-row flag (clock minutes computed once)."""
    if "first_in" in records.columns and "last_out" in records.columns:
        # report-A records carry the instants the texts were formatted from
        missing = F.col("LastOut").isNull() | F.col("LastOut").isin(P.A_MISSING_CHECKOUT, P.A_NO_HOURS)
        in_m = minute_of_day(F.col("first_in"))
        out_m = F.when(~missing, minute_of_day(F.col("last_out")))
    else:
        in_m, out_m = _clock_minutes(F.col("FirstIn")), _clock_minutes(F.col("LastOut"))
    mins = records.select("EmployeeID", "Date", "TotalHours", "hours", "Status", in_m.alias("__in_m"), out_m.alias("__out_m"))
    return mins.select(
        "EmployeeID",
        "Date",
        in_band_of(F.col("__in_m")).alias("in_band"),
        out_band_of(F.col("__out_m")).alias("out_band"),
        hours_band(F.col("hours"), F.col("TotalHours") == P.A_NO_HOURS).alias("hours_band"),
        status_severity(F.col("Status")).alias("severity"),
        (F.upper(F.col("Status")) == P.A_INCOMPLETE.upper()).alias("flagged"),
    )


def trend_bands(trend: DataFrame) -> DataFrame:
    """D4 cuts applied to A13 trend points."""
    return trend.select("date", "avgHours", hours_band(F.col("avgHours"), F.lit(False)).alias("band"))


def employee_summary(records: DataFrame) -> DataFrame:
    """D6+D7: per employee days, hours, late/early counts and compliance score (1 decimal, cap 100)."""
    up = F.upper(F.coalesce(F.col("Status"), F.lit("")))
    agg = records.groupBy("EmployeeID").agg(
        F.max("Name").alias("Name"),
        F.count(F.lit(1)).alias("TotalDays"),
        F.coalesce(F.sum("hours_cents"), F.lit(0).cast("bigint")).alias("cents"),
        F.count_if(up.contains("LATE_ENTRY")).alias("LateCount"),
        F.count_if(up.contains("EARLY_EXIT") | (up == "EARLY_DEPARTURE")).alias("EarlyCount"),
    )
    # pct = 100 * (cents/100) / (9 * days) = cents / (9 * days); tenths half-up.
    tenths = F.least(half_up_ratio(F.col("cents") * 10, F.col("TotalDays") * P.EXPECTED_HOURS_PER_DAY), F.lit(1000).cast("bigint"))
    pct = (tenths / F.lit(10.0)).cast("double")
    (lo_cut, lo_label), (mid_cut, mid_label) = P.COMPLIANCE_BANDS
    band = F.when(pct < lo_cut, lo_label).when(pct < mid_cut, mid_label).otherwise(F.lit("success"))
    return agg.select(
        "EmployeeID",
        "Name",
        "TotalDays",
        "LateCount",
        "EarlyCount",
        cents_to_double(F.col("cents")).alias("TotalHoursWorked"),
        (F.col("TotalDays") * P.EXPECTED_HOURS_PER_DAY).cast("bigint").alias("ExpectedHours"),
        pct.alias("CompliancePct"),
        band.alias("ComplianceBand"),
    )


SORTABLE = ("EmployeeID", "Name", "Department", "EmpType", "Date", "Weekday", "FirstIn", "LastOut", "TotalHours", "Status")


def sort_key(column: str) -> Column:
    """D8 key: hours numeric (non-numbers = 0), Date as text, others lower-cased trimmed text."""
    if column == "TotalHours":
        return F.coalesce(F.col("hours"), F.lit(0.0))
    if column == "Date":
        return F.col("Date")
    return F.lower(js_trim(F.coalesce(F.col(column).cast("string"), F.lit(""))))


def sort_order(column: str | None = None, direction: str = "asc") -> list[Column]:
    """D8 order: one grid column, ties by the default order (date desc, ID)."""
    tie = [F.col("Date").desc(), F.col("EmployeeID").asc()]
    if column is None:
        return tie
    if column not in SORTABLE:
        raise ValueError(f"unknown sort column {column!r}")
    key = sort_key(column)
    return [key.desc() if direction == "desc" else key.asc(), *tie]


def sort_records(records: DataFrame, column: str | None = None, direction: str = "asc") -> DataFrame:
    """Records in ``sort_order``."""
    return records.orderBy(*sort_order(column, direction))


TOP_ROWS = 10_000
"""Rows up to which a page is the tail of a top-k, held by one task; deeper pages go by position."""


def page(records: DataFrame, n: int = 1, size: int = 10, column: str | None = None, direction: str = "asc") -> DataFrame:
    """Rows (n-1)*size+1 .. n*size of the sorted records, at any depth without a gather of what lies before."""
    n = max(1, int(n))
    if n * size > TOP_ROWS:
        placed = dense_index(records, sort_order(column, direction), "__place", dtype="bigint")
        return placed.where(F.col("__place").between((n - 1) * size + 1, n * size)).orderBy("__place").drop("__place")
    return sort_records(records, column, direction).offset((n - 1) * size).limit(size)


def page_totals(records: DataFrame, size: int = 10) -> DataFrame:
    """D9 totals: record count and page count."""
    return records.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.ceil(F.col("total") / F.lit(size)).cast("bigint").alias("pages")
    )


def timeline(records: DataFrame) -> DataFrame:
    """Per employee-day, ordered events: first check-in, then last check-out (or missing)."""
    missing = F.col("LastOut").isNull() | F.col("LastOut").isin(P.A_MISSING_CHECKOUT, P.A_NO_HOURS)
    events = F.array(
        F.struct(F.lit(1).alias("seq"), F.lit(P.TIMELINE_IN).alias("event"), F.col("FirstIn").alias("time")),
        F.struct(
            F.lit(2).alias("seq"),
            F.lit(P.TIMELINE_OUT).alias("event"),
            F.when(missing, F.lit(P.TIMELINE_MISSING)).otherwise(F.col("LastOut")).alias("time"),
        ),
    )
    return records.select("EmployeeID", "Name", "Date", F.inline(events))
