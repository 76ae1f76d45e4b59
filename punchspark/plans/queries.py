"""Registered queries over the bundled test tables: (spark, sf_dir) -> DataFrame.

Each returns unordered rows (except where order is the feature, e.g. a page) and
aliases every column so it lines up with its SQL oracle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punchspark import policy as P
from punchspark.functions.dtparse import merge_date_time, with_punch_datetime
from punchspark.functions.text import normalize_name
from punchspark.functions.timefmt import india_stamp, minutes_to_time, time_to_minutes
from punchspark.operators import identity as ID
from punchspark.operators import ingest as I
from punchspark.operators import report_a as A
from punchspark.operators import report_b as B
from punchspark.operators import roster as R
from punchspark.operators import rollups as D
from punchspark.plans import driver_tables as DT
from punchspark.plans.dashboard import dashboard_bundle as bundle
from punchspark.plans.driver_tables import engine_tables
from punchspark.plans.export import export_report
from punchspark.session import ensure_checkpoint_dir
from punchspark.sources import sinks, tables, uploads
from punchspark.sources.tables import USERS_SCHEMA
from punchspark.sources.uploads import check_uploads, with_missing_columns
from punchspark.streaming.punch_stream import start_punch_stream

# Parameters of the filtered variants (fixed so the oracle can use the same).
FILTER_START = "2024-01-05"
FILTER_END = "2024-01-20"
FILTER_DEPARTMENT_ID = 19
FILTER_EMPLOYEE = "1"
FILTER_STATUS = "OVERTIME"
EXPORT_DEPARTMENT = "nation_3"
EXPORT_STATUS = "late arrival"
EXPORT_SEARCH = "customer#0000001"
PAGE_NUMBER = 2
PAGE_SIZE = 10

A_OUT = A.RECORD_COLUMNS + ("hours",)
B_OUT = B.RECORD_COLUMNS + ("hours", "punch_count")


def records_a(spark: SparkSession, sf_dir: str, **filters) -> DataFrame:
    punches, users, departments = engine_tables(spark, sf_dir)
    return A.daily_attendance(punches, users, departments, **filters)


def daily_attendance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records_a(spark, sf_dir).select(*A_OUT)


def daily_attendance_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records_a(
        spark, sf_dir, start=FILTER_START, end=FILTER_END, department_id=FILTER_DEPARTMENT_ID, employee=FILTER_EMPLOYEE
    ).select(*A_OUT)


def daily_attendance_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records_a(spark, sf_dir, status=FILTER_STATUS).select(*A_OUT)


def status_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.status_distribution(records_a(spark, sf_dir))


def daily_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.daily_trend(records_a(spark, sf_dir))


def active_punches(spark: SparkSession, sf_dir: str) -> DataFrame:
    punches, users, departments = engine_tables(spark, sf_dir)
    out = A.active_punches(punches, users, departments)
    return out.select(
        "EmployeeNo", "FirstName", "LastName", "DepartmentName", "EmpType", F.date_format("LogDate", "yyyy-MM-dd").alias("LogDate"), "LogTime"
    )


def summary_widgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.summary_widgets(records_a(spark, sf_dir))


def time_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.time_bands(records_a(spark, sf_dir))


def employee_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.employee_summary(records_a(spark, sf_dir))


def records_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.page(records_a(spark, sf_dir), PAGE_NUMBER, PAGE_SIZE, "TotalHours", "desc").select(*A_OUT)


def punch_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.timeline(records_a(spark, sf_dir))


def _with_lists(records: DataFrame) -> DataFrame:
    return records.select(*B_OUT, F.array_join("Punches", ", ").alias("Punches"))


def export_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    punches, users, departments = engine_tables(spark, sf_dir)
    return _with_lists(B.daily_report_b(punches, users, departments, punch_list=True))


def export_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    punches, users, departments = engine_tables(spark, sf_dir)
    return B.daily_report_b(
        punches,
        users,
        departments,
        from_date=FILTER_START,
        to_date=FILTER_END,
        department=EXPORT_DEPARTMENT,
        status=EXPORT_STATUS,
        search=EXPORT_SEARCH,
    ).select(*B_OUT)


# ---------------------------------------------------------------------------
# Ingestion (P*) over a punch upload derived from events, roster named from part
# ---------------------------------------------------------------------------



def _ingest(spark: SparkSession, sf_dir: str) -> I.IngestResult:
    events, part, customer = (DT.table(spark, sf_dir, t) for t in ("events", "part", "customer"))
    upload = DT.punch_upload_from_events(events, part)
    return I.ingest_punch_upload(upload, DT.named_roster(customer, part))


def punch_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingest(spark, sf_dir).punches.select(
        "EmployeeNo",
        F.date_format("PunchDateTime", "yyyy-MM-dd HH:mm:ss").alias("PunchDateTime"),
        "DeviceName",
        "AreaName",
        "Status",
        "match_method",
    )


def ingest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingest(spark, sf_dir).metrics


def facility_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, part = DT.table(spark, sf_dir, "events"), DT.table(spark, sf_dir, "part")
    cells = ID.punch_cells(DT.punch_upload_from_events(events, part))
    flagged = I.exclude_facilities(cells)
    return flagged.groupBy("DeviceName", F.col("facility").alias("excluded")).agg(F.count(F.lit(1)).alias("rows"))


def punch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _ingest(spark, sf_dir).groups
    return g.where(~F.col("dropped") & (F.col("n") > 1)).select(
        "EmployeeNo",
        F.date_format("PunchDateTime", "yyyy-MM-dd HH:mm:ss").alias("PunchDateTime"),
        F.col("n").alias("copies"),
        F.col("first.DeviceName").alias("KeptDevice"),
    )


# Text layouts the punch-time parser is checked against (pattern per event type).
DATE_LAYOUTS = {
    "view": ("yyyy-MM-dd", "HH:mm:ss"),
    "click": ("dd-MM-yyyy", "H:mm:ss"),
    "purchase": ("MM/dd/yyyy", "HH:mm"),
    "signup": ("d MMM yyyy", "H:mm:ss"),
    "error": ("M/d/yyyy", "H:m:s"),
}


def datetime_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11 over every event: the event time written in one of DATE_LAYOUTS, parsed back."""
    ev = DT.table(spark, sf_dir, "events")
    d = F.lit(None).cast("string")
    t = F.lit(None).cast("string")
    for et, (dfmt, tfmt) in DATE_LAYOUTS.items():
        d = F.when(F.col("event_type") == et, F.date_format("ts", dfmt)).otherwise(d)
        t = F.when(F.col("event_type") == et, F.date_format("ts", tfmt)).otherwise(t)
    cells = ev.select("event_id", "event_type", d.alias("date_cell"), t.alias("time_cell"))
    parsed = with_punch_datetime(cells, "date_cell", "time_cell", "parsed")
    return parsed.select("event_id", "date_cell", "time_cell", F.date_format("parsed", "yyyy-MM-dd HH:mm:ss").alias("parsed"))


def datetime_rough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11/P12 over every event, by event_id: free text with AM/PM, dotted month first, a time without
    hour, a serial with a text time, a day past the month's end, no date, no date at all in the text."""
    kind = F.col("event_id") % 7
    text = lambda fmt: F.date_format("ts", fmt)
    serial = F.datediff(F.to_date("ts"), F.lit("1899-12-30").cast("date")).cast("string")
    past = F.concat(F.lit("35-"), text("MM-yyyy"))
    d = F.when(kind == 0, text("d MMM yyyy")).when(kind == 1, text("MM.dd.yyyy")).when(kind == 2, text("yyyy-MM-dd")).when(kind == 3, serial)
    d = d.when(kind == 4, past).when(kind == 5, F.lit("")).otherwise(F.lit("no date"))
    t = F.when(kind == 0, text("h:mm a")).when(kind == 2, text("':'mm")).otherwise(text("H:mm"))
    cells = DT.table(spark, sf_dir, "events").select("event_id", d.alias("date_cell"), t.alias("time_cell"))
    parsed = with_punch_datetime(cells, "date_cell", "time_cell", "parsed")
    return parsed.select("event_id", "date_cell", "time_cell", F.date_format("parsed", "yyyy-MM-dd HH:mm:ss").alias("parsed"))


def excel_serial_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12 over every event: serial day number + day fraction (6 decimals), parsed back."""
    ev = DT.table(spark, sf_dir, "events")
    serial = F.datediff(F.to_date("ts"), F.lit("1899-12-30").cast("date"))
    secs = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    micro_days = F.floor((secs.cast("bigint") * 2_000_000 + 86400) / F.lit(172800)).cast("bigint")  # half-up, exact
    frac = F.concat(F.lit("0."), F.lpad(micro_days.cast("string"), 6, "0"))
    cells = ev.select("event_id", serial.cast("string").alias("date_cell"), frac.alias("time_cell"))
    parsed = with_punch_datetime(cells, "date_cell", "time_cell", "parsed")
    return parsed.select("event_id", "date_cell", "time_cell", F.date_format("parsed", "yyyy-MM-dd HH:mm:ss").alias("parsed"))


def name_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4 over every part: a badge-style decorated name (NULL marker, (brand), size digits)."""
    part = DT.table(spark, sf_dir, "part")
    raw = F.concat(F.lit("NULL "), F.upper("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(") "), F.col("p_size").cast("string"), F.lit(" x."))
    return part.select("p_partkey", raw.alias("raw"), normalize_name(raw).alias("normalized"))


def name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5-P9 over every part row as an unread-card punch: the name written four ways."""
    part, customer = DT.table(spark, sf_dir, "part"), DT.table(spark, sf_dir, "customer")
    w1 = F.element_at(F.split("p_name", " "), 1)
    w2 = F.element_at(F.split("p_name", " "), -1)
    style = F.pmod(F.col("p_size"), F.lit(4))
    first = (
        F.when(style == 0, w1)
        .when(style == 1, w2)
        .when(style == 2, F.concat(F.upper(w1), F.lit(" Q.")))
        .otherwise(F.substring(w1, 1, 4))
    )
    last = F.when(style == 0, w2).when(style == 1, w1).when(style == 2, F.concat(w2, F.lit(" 07"))).otherwise(F.lit(""))
    upload = part.select(
        F.lit("0").alias("PersonNo"),
        first.alias("PersonFirstName"),
        last.alias("PersonLastName"),
        F.lit("parts").alias("upload_id"),
        F.struct(F.lit(0).cast("bigint").alias("blk"), F.col("p_partkey").alias("rec")).alias("row_ord"),
        F.col("p_partkey"),
    )
    cells = ID.punch_cells(upload).join(upload.select("row_ord", "p_partkey"), "row_ord")
    resolved = ID.resolve_identity(cells, DT.named_roster(customer, part))
    return resolved.select("p_partkey", "first_cell", "last_cell", "EmployeeNo", "unauthorized", "match_method")


# ---------------------------------------------------------------------------
# Roster sync (R*) over a roster upload from customer, existing staff from supplier
# ---------------------------------------------------------------------------


def _sync(spark: SparkSession, sf_dir: str) -> R.RosterSync:
    customer, supplier, nation = (DT.table(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    return R.sync_roster(
        DT.users_from_supplier(supplier), DT.departments_from_nation(nation), DT.roster_upload_from_customer(customer)
    )


def roster_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sync(spark, sf_dir).users


def roster_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sync(spark, sf_dir).metrics


def department_provision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sync(spark, sf_dir).departments


def directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, users, departments = engine_tables(spark, sf_dir)
    return R.directory(users, departments)


def directory_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, users, departments = engine_tables(spark, sf_dir)
    return R.directory(users, departments, strict=True)


DIRECTORY_QUERY = "nation_1"


def directory_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, users, departments = engine_tables(spark, sf_dir)
    return R.directory_filter(R.directory(users, departments), "Active", DIRECTORY_QUERY)


def departments_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, departments = engine_tables(spark, sf_dir)
    return R.departments_list(departments)


def _admin_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admin requests from supplier rows: one create/update/toggle per supplier."""
    s = DT.table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("req_ord"),
        F.concat(F.lit(" s"), F.col("s_suppkey").cast("string")).alias("employeeNo"),
        F.concat(F.lit(" "), F.col("s_name"), F.lit(" ")).alias("firstName"),
        F.when(F.col("s_acctbal") >= 0, F.lit("Vendor")).otherwise(F.lit("")).alias("lastName"),
        F.col("s_nationkey").cast("string").alias("departmentId"),
        F.lit("User").alias("role"),
        F.lit("pw").alias("password"),
        F.col("s_suppkey"),
        F.col("s_acctbal"),
    )


def users_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, users, _ = engine_tables(spark, sf_dir)
    new_users, _ = R.create_users(users, _admin_requests(spark, sf_dir))
    return new_users


def users_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, users, _ = engine_tables(spark, sf_dir)
    req = _admin_requests(spark, sf_dir).withColumn("employeeNo", F.col("s_suppkey").cast("string"))
    return R.update_users(users, req)


def users_set_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, users, _ = engine_tables(spark, sf_dir)
    req = _admin_requests(spark, sf_dir).select(
        "req_ord",
        F.col("s_suppkey").cast("string").alias("employeeNo"),
        F.when(F.col("s_acctbal") > 5000, F.lit(True)).when(F.col("s_acctbal") > 0, F.lit(None)).otherwise(F.lit(False)).alias("isActive"),
    )
    return R.set_active(users, req)


# ---------------------------------------------------------------------------
# Report B over rough punches, and the smaller operators
# ---------------------------------------------------------------------------

ROUGH_STATUS = P.UNAUTHORIZED


def _rough(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    _, users, departments = engine_tables(spark, sf_dir)
    return DT.rough_punches_from_events(DT.table(spark, sf_dir, "events")), users, departments


def all_punches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: every punch with its user and department."""
    out = B.all_punches(*_rough(spark, sf_dir))
    shown = F.date_format("PunchDateTime", "yyyy-MM-dd HH:mm:ss").alias("PunchDateTime")
    return out.select("LogID", "EmployeeNo", shown, "LogStatus", "FirstName", "LastName", "EmpType", "Department")


def export_rough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2-B6 with every fallback: unknown IDs, people without a user, unauthorized entries, ties."""
    return _with_lists(B.daily_report_b(*_rough(spark, sf_dir), punch_list=True))


def export_repeated_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2-B6 when every EmployeeNo comes twice in users: the earliest user stands, and no punch counts twice."""
    punches, users, departments = _rough(spark, sf_dir)
    again = users.withColumns({"UserID": (F.col("UserID") + 1_000_000).cast(users.schema["UserID"].dataType), "FirstName": F.lit("Second")})
    return B.daily_report_b(punches, again.unionByName(users), departments).select(*B_OUT)


def punch_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The punches of the days that a filtered report shows."""
    punches, users, departments = _rough(spark, sf_dir)
    dates = {"from_date": FILTER_START, "to_date": FILTER_END}
    records = B.daily_report_b(punches, users, departments, status=ROUGH_STATUS, **dates)
    out = B.daily_punch_list(punches, records=records, **dates)
    return out.withColumn("PunchDateTime", F.date_format("PunchDateTime", "yyyy-MM-dd HH:mm:ss"))


def report_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report as CSV lines."""
    return sinks.report_csv_lines(B.daily_report_b(*_rough(spark, sf_dir)))


def header_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 over one upload header per part: by size it lacks a required name or has them in lower case."""
    size = F.col("p_size")
    names = F.array(*[F.lit(h) for h in P.REQUIRED_UPLOAD_HEADERS])
    kept = F.filter(names, lambda h, i: i != size % 5)
    header = F.when(size % 7 == 0, F.transform(kept, F.lower)).otherwise(kept)
    uploads = DT.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("upload_id"), F.concat(F.array("p_brand"), header).alias("header"))
    return check_uploads(uploads).withColumn("missing", F.concat_ws(",", "missing"))


def missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of an older table without EmpType and Role."""
    _, users, _ = engine_tables(spark, sf_dir)
    return with_missing_columns(users.drop("EmpType", "Role"), USERS_SCHEMA)


def export_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export line per event."""
    uid = F.col("user_id").cast("string")
    filters = F.create_map(F.lit("format"), F.col("event_type"), F.lit("search"), uid)
    events = DT.table(spark, sf_dir, "events").select(
        india_stamp("ts").alias("ts"), F.concat(F.lit("User "), uid).alias("name"), uid.alias("username"), F.col("event_type").alias("format"), filters.alias("filters")
    )
    return sinks.export_audit_lines(events)


def session_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session line per event; 'error' events carry a status."""
    uid = F.col("user_id").cast("string")
    events = DT.table(spark, sf_dir, "events").select(
        india_stamp("ts").alias("ts"),
        F.upper("event_type").alias("action"),
        uid.alias("user_id"),
        F.concat(F.lit("User "), uid).alias("name"),
        F.lit(P.DEFAULT_ROLE).alias("role"),
        F.when(F.col("event_type") == "error", F.lit("FAILED")).alias("status"),
    )
    return sinks.session_audit_lines(events)


def merge_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A typed date and a time text (absent, empty, with and without seconds)."""
    e = F.col("event_id")
    hm = F.concat((e % 24).cast("string"), F.lit(":"), (e % 60).cast("string"))
    text = F.when(e % 4 == 0, None).when(e % 4 == 1, F.lit("")).when(e % 4 == 2, hm).otherwise(F.concat(hm, F.lit(":7")))
    out = DT.table(spark, sf_dir, "events").select("event_id", text.alias("time_cell"), merge_date_time("ts", text).alias("merged"))
    return out.withColumn("merged", F.date_format("merged", "yyyy-MM-dd HH:mm:ss"))


def daily_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report A in display order."""
    return A.order_daily(records_a(spark, sf_dir)).select(*A_OUT)


def dashboard_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The charts of one dashboard as (chart, label, value)."""
    d = bundle(*engine_tables(spark, sf_dir), keep=False)
    parts = (("trend", d.trend, "date", "avgHours"), ("distribution", d.distribution, "Status", "Count"), ("employee", d.employees, "EmployeeID", "CompliancePct"))
    trend, *others = (t.select(F.lit(n).alias("chart"), F.col(k).alias("label"), F.col(v).cast("double").alias("value")) for n, t, k, v in parts)
    for o in others:
        trend = trend.unionAll(o)
    return trend


def trend_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D4 on trend points."""
    return D.trend_bands(A.daily_trend(records_a(spark, sf_dir)))


def page_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and pages."""
    return D.page_totals(records_a(spark, sf_dir), PAGE_SIZE)


def clock_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clock texts (whole, hour only, no number, absent) to minutes and back, and the India stamp."""
    e = F.col("event_id")
    text = F.when(e % 4 == 0, F.date_format("ts", "H:mm")).when(e % 4 == 1, F.date_format("ts", "H")).when(e % 4 == 2, F.date_format("ts", "'x':mm"))
    out = DT.table(spark, sf_dir, "events").select("event_id", text.alias("text"), time_to_minutes(text).alias("minutes"), india_stamp("ts").alias("india"))
    return out.withColumn("clock", minutes_to_time("minutes"))


# ---------------------------------------------------------------------------
# Written and read again: uploads, the punch table, exports, the file stream
# ---------------------------------------------------------------------------


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared one."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4()}"


def _write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').option("emptyValue", "").mode("append").csv(path)


def upload_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event in CSV files of two layouts, with commas and quotes in cells, cut into cells by each file's header."""
    path, events = _scratch(spark, "uploads"), DT.table(spark, sf_dir, "events")
    note = F.concat(F.lit('said "'), F.col("event_type"), F.lit('", at '), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    cells = events.select(F.col("event_id").cast("string").alias("Event ID"), note.alias("Note"), F.col("event_type").alias("Kind"), F.when(F.col("event_id") % 3 == 0, F.col("props")).alias("Props"))
    even = F.col("Event ID").cast("long") % 2 == 0
    _write_csv(cells.where(even), path)
    _write_csv(cells.where(~even).select("Props", F.lit("x").alias("Extra"), F.col("Kind").alias("KIND"), "Note", F.col("Event ID").alias("eventid")), path)
    cell = lambda k: F.try_element_at("cells", F.lit(k))
    return uploads.read_csv_uploads(spark, path).select(cell("eventid").cast("long").alias("event_id"), cell("note").alias("note"), cell("kind").alias("kind"), cell("props").alias("props"))


def punches_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every punch appended to a stored table, one load of it twice as after a crash, and read back by schema."""
    warehouse = _scratch(spark, "warehouse")
    punches, _, _ = engine_tables(spark, sf_dir)
    for load, rows in (("a", "LogID % 2 = 0"), ("b", "LogID % 2 = 1"), ("a", "LogID % 2 = 0")):
        sinks.append_punches(punches.where(rows), f"{warehouse}/punches", load)
    return tables.punches(spark, warehouse).select("EmployeeNo", F.date_format("PunchDateTime", "yyyy-MM-dd HH:mm:ss").alias("PunchDateTime"), "Status")


def export_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The CSV export of a whole report, read back as lines."""
    punches, users, departments = _rough(spark, sf_dir)
    path = export_report(spark, punches, users, departments, "csv", _scratch(spark, "exports"))["path"]
    lines = spark.read.text(path)
    return lines.where(~F.col("value").startswith('"Employee ID"')).select(F.col("value").alias("line"))


def punch_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The punch upload as files of a stream that takes what is there and stops; what it has stored, each punch once."""
    base = _scratch(spark, "stream")
    events, part, customer = (DT.table(spark, sf_dir, t) for t in ("events", "part", "customer"))
    upload = DT.punch_upload_from_events(events, part).drop("upload_id", "row_ord")
    _write_csv(upload, f"{base}/in")
    query = start_punch_stream(spark, f"{base}/in", upload.columns, lambda s: DT.named_roster(customer, part), f"{base}/punches", f"{base}/metrics", f"{base}/progress", cross_file_dedup=True)
    query.awaitTermination()
    return spark.read.parquet(f"{base}/punches").select("EmployeeNo", F.date_format("PunchDateTime", "yyyy-MM-dd HH:mm:ss").alias("PunchDateTime"))


REGISTRY = {
    "upload_csv": upload_csv,
    "punches_stored": punches_stored,
    "export_written": export_written,
    "punch_stream": punch_stream,
    "all_punches": all_punches,
    "export_rough": export_rough,
    "export_repeated_users": export_repeated_users,
    "punch_list": punch_list,
    "report_csv_lines": report_csv_lines,
    "header_check": header_check,
    "missing_columns": missing_columns,
    "export_audit": export_audit,
    "session_audit": session_audit,
    "merge_datetime": merge_datetime,
    "daily_ordered": daily_ordered,
    "dashboard_bundle": dashboard_bundle,
    "trend_bands": trend_bands,
    "page_totals": page_totals,
    "clock_texts": clock_texts,
    "daily_attendance": daily_attendance,
    "daily_attendance_filtered": daily_attendance_filtered,
    "daily_attendance_by_status": daily_attendance_by_status,
    "status_distribution": status_distribution,
    "daily_trend": daily_trend,
    "active_punches": active_punches,
    "summary_widgets": summary_widgets,
    "time_bands": time_bands,
    "employee_compliance": employee_compliance,
    "records_page": records_page,
    "punch_timeline": punch_timeline,
    "export_daily": export_daily,
    "export_filtered": export_filtered,
    "punch_ingest": punch_ingest,
    "ingest_metrics": ingest_metrics,
    "facility_exclusion": facility_exclusion,
    "punch_dedup": punch_dedup,
    "datetime_parse": datetime_parse,
    "datetime_rough": datetime_rough,
    "excel_serial_parse": excel_serial_parse,
    "name_normalize": name_normalize,
    "name_match": name_match,
    "roster_upsert": roster_upsert,
    "roster_metrics": roster_metrics,
    "department_provision": department_provision,
    "directory": directory,
    "directory_strict": directory_strict,
    "directory_filter": directory_filter,
    "departments_list": departments_list,
    "users_create": users_create,
    "users_update": users_update,
    "users_set_active": users_set_active,
}
