"""Daily record B — the export report.

Differs from A on purpose: left joins (orphan punches stay), group key is the
trimmed ID or 'UNKNOWN', late after 9:00, overtime on *rounded* hours and first
in precedence, single punches split at 13:00, 'Unauthorized Entry' overrides.

Plan shape: punches are aggregated per (ID, date) first — min, max, count and
the earliest row's ID and status via ``min_by`` on (time, LogID) — all
partial-aggregable, so a hot key ('UNKNOWN', 'NOT PROVIDED') is combined map-side
and never gathered in one task. The earliest row's ID is then joined to users
and departments, which yields the attributes the reference takes from the
group's first row. The plan is the same at every size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punchspark import policy as P
from punchspark.functions.text import js_trim, null_text_to_empty
from punchspark.functions.timefmt import (
    cents_js_number,
    cents_to_double,
    format_ampm,
    hours_cents,
    minute_of_day,
    weekday_name,
)
from punchspark.operators.common import broadcast_if_small
from punchspark.functions.dtparse import codegen_barrier
from punchspark.operators.report_a import punch_date_range

RECORD_COLUMNS = (
    "EmployeeID",
    "FirstName",
    "LastName",
    "Name",
    "Department",
    "EmpType",
    "Date",
    "rawDate",
    "Weekday",
    "FirstIn",
    "LastOut",
    "TotalHours",
    "Status",
    "rawFirstInMins",
    "rawLastOutMins",
)


def group_id(c) -> F.Column:
    """Trimmed ID, or 'UNKNOWN' when null/empty."""
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(P.UNKNOWN_ID)).otherwise(js_trim(c))


def all_punches(punches: DataFrame, users: DataFrame, departments: DataFrame) -> DataFrame:
    """B1: every punch with its user and department (left joins)."""
    u = users.select("EmployeeNo", "FirstName", "LastName", "EmpType", "DepartmentID")
    d = departments.select("DepartmentID", F.col("DepartmentName").alias("Department"))
    return (
        punches.select("LogID", "EmployeeNo", "PunchDateTime", F.col("Status").alias("LogStatus"))
        .join(broadcast_if_small(u), "EmployeeNo", "left")
        .join(broadcast_if_small(d), "DepartmentID", "left")
    )


def _head_key() -> F.Column:
    """Order of punches within a group as one fixed-width value: (time, LogID)."""
    micros = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col("PunchDateTime"))
    log_id = F.coalesce(F.col("LogID"), F.lit(0)).cast("decimal(38,0)") + F.lit(str(2**63)).cast("decimal(38,0)")
    return micros.cast("decimal(38,0)") * F.lit(str(10**20)).cast("decimal(38,0)") + log_id


def daily_groups(punches: DataFrame, from_date=None, to_date=None, punch_list: bool = False) -> DataFrame:
    """B2 core: per (trimmed ID, date): first/last punch, count, and the earliest row's raw ID and status.

    Punches are first grouped by their raw ID, so that all that is carried has a fixed width (a hash
    aggregate, combined map-side); the few spellings of an ID then meet. With ``punch_list``
    they are grouped by minute too, and the group gets ``runs``: its (minute, punches) in no
    order, of which a day has 1440 for each spelling, however many punches it has.
    """
    p = punches.select(
        "LogID",
        "EmployeeNo",
        "PunchDateTime",
        F.col("Status").alias("LogStatus"),
        *(["punch_date"] if "punch_date" in punches.columns else []),
    )
    if from_date or to_date:
        p = _date_bounds(p, from_date, to_date)
    unauth = F.coalesce(F.col("LogStatus") == F.lit(P.UNAUTHORIZED), F.lit(False))
    by = [F.col("EmployeeNo").alias("raw_id"), F.to_date("PunchDateTime").alias("day")]
    spelled = p.groupBy(*by, *([minute_of_day("PunchDateTime").cast("int").alias("minute")] if punch_list else [])).agg(
        F.min("PunchDateTime").alias("first_in"),
        F.max("PunchDateTime").alias("last_out"),
        F.count(F.lit(1)).alias("n"),
        F.min(_head_key()).alias("head_key"),
        F.min_by(unauth, _head_key()).alias("unauth"),
    )
    runs = [F.collect_list(F.struct("minute", "n")).alias("runs")] if punch_list else []
    return spelled.groupBy(group_id(F.col("raw_id")).alias("EmployeeID"), "day").agg(
        F.min("first_in").alias("first_in"),
        F.max("last_out").alias("last_out"),
        F.sum("n").alias("punch_count"),
        F.min_by(F.struct("raw_id", "unauth"), "head_key").alias("head"),
        *runs,
    )


def punch_texts(runs: F.Column) -> F.Column:
    """The ordered punch list of a day, one text a punch, from its (minute, punches).

    Punches of one minute have one text, so their order within it does not show. The list is made
    when its row is written; up to there a day is no longer than its minutes.
    """
    hour = lambda m: (F.floor(m / 60) + 11) % 12 + 1
    text = lambda m: F.concat(hour(m).cast("string"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"), F.when(m < 720, " AM").otherwise(" PM"))
    return F.flatten(F.transform(F.sort_array(runs), lambda r: F.array_repeat(text(r["minute"]), r["n"].cast("int"))))


def _date_bounds(p: DataFrame, from_date, to_date) -> DataFrame:
    if from_date and to_date:
        return punch_date_range(p, from_date, to_date)
    days = [F.to_date("PunchDateTime")] + [F.col(c) for c in ("punch_date",) if c in p.columns]
    for day in days:  # the stored date prunes partitions
        p = p.where(day >= F.lit(str(from_date)).cast("date")) if from_date else p.where(day <= F.lit(str(to_date)).cast("date"))
    return p


def _same(c: F.Column, value: str) -> F.Column:
    """Equal ignoring case and outer white space."""
    return F.lower(js_trim(F.coalesce(c, F.lit("")))) == value.strip().lower()


def of_department(punches: DataFrame, users: DataFrame, departments: DataFrame, department: str | None) -> DataFrame:
    """B7 below the aggregate: punches of the groups that can be of ``department``.

    Only a user's punch brings a group into a named department; whole groups are kept, so
    the aggregate is unchanged. The default name also holds people without a user.
    """
    if not department or department == "All" or department.strip().lower() == P.B_DEFAULT_DEPARTMENT.lower():
        return punches
    named = broadcast_if_small(departments.where(_same(F.col("DepartmentName"), department)).select("DepartmentID"))
    ids = users.join(named, "DepartmentID", "left_semi").select(group_id(F.col("EmployeeNo")).alias("__id")).distinct()
    return punches.join(broadcast_if_small(ids), group_id(F.col("EmployeeNo")) == F.col("__id"), "left_semi")


def _full_name() -> F.Column:
    return js_trim(F.concat(null_text_to_empty(F.col("FirstName")), F.lit(" "), null_text_to_empty(F.col("LastName"))))


def of_search(punches: DataFrame, users: DataFrame, search: str | None) -> DataFrame:
    """B7 below the aggregate: punches of the groups whose ID or user's name holds ``search``.

    Whole groups are kept, so the aggregate is unchanged. A text that the labels of
    groups without a name hold can match any group, and then all punches stay.
    """
    text = (search or "").strip().lower()
    if not text or any(text in label.lower() for label in (P.UNAUTHORIZED, P.B_UNKNOWN_NAME)):
        return punches
    ids = users.where(F.lower(_full_name()).contains(text)).select(group_id(F.col("EmployeeNo")).alias("__id")).distinct()
    own = group_id(F.col("EmployeeNo"))
    marked = punches.join(broadcast_if_small(ids), own == F.col("__id"), "left")
    return marked.where(F.col("__id").isNotNull() | F.lower(own).contains(text)).drop("__id")


def classify_b(groups: DataFrame, users: DataFrame, departments: DataFrame, pol: P.ShiftPolicy = P.POLICY_B) -> DataFrame:
    """Display fallbacks, single-punch rules, status and presentation."""
    d = departments.select("DepartmentID", F.col("DepartmentName").alias("DeptName"))
    attrs = ["FirstName", "LastName", "EmpType", "DepartmentID"]
    # an EmployeeNo stands for one user: the earliest, should the table hold more
    ids = users.groupBy(F.col("EmployeeNo").alias("raw_id")).agg(F.min("UserID").alias("head_uid"))
    u = users.select(F.col("UserID").alias("head_uid"), *attrs)
    g = groups.select("*", F.col("head.raw_id").alias("raw_id"), F.col("head.unauth").alias("LogUnauth")).drop("head")
    j = g.join(broadcast_if_small(ids), "raw_id", "left").join(broadcast_if_small(u), "head_uid", "left")
    j = j.join(broadcast_if_small(d), "DepartmentID", "left")

    # Base values once, as columns (each is used by several outputs).
    first, last = F.col("first_in"), F.col("last_out")
    j = j.withColumns(
        {
            "__single": first == last,
            "__morning": F.hour(first) < pol.single_punch_noon_hour,
            "__cents": F.greatest(hours_cents(first, last), F.lit(0).cast("bigint")),
            "__late": minute_of_day(first) > pol.late_after_minute,
            "__early": minute_of_day(last) < pol.early_before_minute,
        }
    )
    unauthorized = F.col("LogUnauth")
    single, morning, cents = F.col("__single"), F.col("__morning"), F.col("__cents")
    late, early = F.col("__late"), F.col("__early")
    over = cents > F.lit(int(round(pol.overtime_hours * 100)))
    multi_status = (
        F.when(over, P.B_OVERTIME)
        .when(late & early, P.B_LATE_EARLY)
        .when(late, P.B_LATE)
        .when(early, P.B_EARLY)
        .otherwise(P.B_COMPLIANT)
    )
    # B5 (multi_status above): rounded overtime first, then late/early; B4: single punch split at noon
    status = (
        F.when(unauthorized, F.lit(P.UNAUTHORIZED))
        .when(single & morning, F.lit(P.B_EARLY))
        .when(single, F.lit(P.B_LATE))
        .otherwise(multi_status)
    )
    fname = null_text_to_empty(F.col("FirstName"))
    lname = null_text_to_empty(F.col("LastName"))
    full = _full_name()
    name = (
        F.when(full != "", full)
        .when(unauthorized, F.lit(P.UNAUTHORIZED))
        .otherwise(F.lit(P.B_UNKNOWN_NAME))
    )
    dept = F.when(F.coalesce(F.col("DeptName"), F.lit("")) != "", js_trim(F.col("DeptName"))).otherwise(
        F.lit(P.B_DEFAULT_DEPARTMENT)
    )
    emp_type = F.when(F.coalesce(F.col("EmpType"), F.lit("")) != "", js_trim(F.col("EmpType"))).otherwise(
        F.lit(P.B_DEFAULT_EMPTYPE)
    )
    in_ts = F.when(~single | morning, first)
    out_ts = F.when(~single, last).when(~morning, first)
    total = F.when(single & morning, F.lit(P.B_NOT_OUT)).when(single, F.lit(P.B_NOT_IN)).otherwise(cents_js_number(cents))
    return j.select(
        "EmployeeID",
        fname.alias("FirstName"),
        lname.alias("LastName"),
        name.alias("Name"),
        dept.alias("Department"),
        emp_type.alias("EmpType"),
        F.date_format("day", "dd-MM-yyyy").alias("Date"),
        F.date_format("day", "yyyy-MM-dd").alias("rawDate"),
        weekday_name("day").alias("Weekday"),
        format_ampm(in_ts).alias("FirstIn"),
        format_ampm(out_ts).alias("LastOut"),
        total.alias("TotalHours"),
        status.alias("Status"),
        minute_of_day(in_ts).alias("rawFirstInMins"),
        minute_of_day(out_ts).alias("rawLastOutMins"),
        F.when(~single, cents_to_double(cents)).alias("hours"),
        "punch_count",
        *([punch_texts(F.col("runs")).alias("Punches")] if "runs" in groups.columns else []),
    )


def filter_b(records: DataFrame, department: str | None = None, status: str | None = None, search: str | None = None) -> DataFrame:
    """B7 (post-aggregate part): department name and status equal ignoring case/space; search in Name or ID."""
    out = records
    if department and department != "All":
        out = out.where(_same(F.col("Department"), department))
    if status and status != "All":
        out = out.where(_same(F.col("Status"), status))
    if search and search.strip():
        s = search.strip().lower()
        out = out.where(
            F.lower(F.coalesce(F.col("Name"), F.lit(""))).contains(s)
            | F.lower(F.coalesce(F.col("EmployeeID"), F.lit(""))).contains(s)
        )
    return out


def daily_report_b(
    punches: DataFrame,
    users: DataFrame,
    departments: DataFrame,
    from_date=None,
    to_date=None,
    department: str | None = None,
    status: str | None = None,
    search: str | None = None,
    pol: P.ShiftPolicy = P.POLICY_B,
    punch_list: bool = False,
) -> DataFrame:
    """Report B records with B7 filters; dates, department and search reach below the aggregate.

    With ``punch_list`` each record has its ``Punches``, in order.
    """
    wanted = of_search(of_department(punches, users, departments, department), users, search)
    groups = daily_groups(wanted, from_date, to_date, punch_list)
    records = classify_b(groups, users, departments, pol)
    if any(x and x != "All" for x in (department, status)) or (search or "").strip():
        # filters on derived columns: evaluate them on the finished rows (no re-inlining)
        records = codegen_barrier(records, "report_b_filter")
    return filter_b(records, department, status, search)


def daily_punch_list(punches: DataFrame, from_date=None, to_date=None, records: DataFrame | None = None) -> DataFrame:
    """B2/B6 punch list in long form: one row per punch, in the order of (EmployeeID,
    PunchDateTime, LogID). ``records`` (a filtered report B) keeps the punches of its days."""
    p = _date_bounds(punches, from_date, to_date) if from_date or to_date else punches
    out = p.select(
        group_id(F.col("EmployeeNo")).alias("EmployeeID"),
        F.date_format("PunchDateTime", "yyyy-MM-dd").alias("rawDate"),
        "PunchDateTime",
        "LogID",
        format_ampm("PunchDateTime").alias("Punch"),
    )
    return out if records is None else out.join(records.select("EmployeeID", "rawDate"), ["EmployeeID", "rawDate"], "left_semi")
