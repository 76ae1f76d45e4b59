"""Report A and B on the FIXTURES.md boundary rows."""

import pytest
from pyspark.sql import functions as F

from helpers import depts_df, punches_df, rows_by, users_df
from punchspark.operators import report_a as A
from punchspark.operators import report_b as B
from punchspark.operators import rollups as D

# (employee, first, last or None, report A, report B)
BOUNDARY = [
    ("E01", "09:00:00", "18:00:00", "ONTIME", "Compliant"),
    ("E02", "09:00:00", "18:00:01", "OVERTIME", "Compliant"),
    ("E03", "09:00:00", "18:00:18", "OVERTIME", "Overtime"),
    ("E04", "09:10:59", "18:00:00", "ONTIME", "Late Arrival"),
    ("E05", "09:11:00", "18:00:00", "LATE_ENTRY_AND_LATE_EXIT", "Late Arrival"),
    ("E06", "09:10:00", "17:59:59", "EARLY_DEPARTURE", "Late & Early"),
    ("E07", "09:11:00", "17:59:59", "LATE_ENTRY_AND_EARLY_EXIT", "Late & Early"),
    ("E08", "08:00:00", "17:30:00", "EARLY_DEPARTURE", "Overtime"),
    ("E09", "12:59:59", None, "Incomplete Record", "Early Departure"),
    ("E10", "13:00:00", None, "Incomplete Record", "Late Arrival"),
]


@pytest.fixture(scope="module")
def tables(spark):
    users = users_df(
        spark,
        [(i + 1, emp, "NULL" if emp == "E02" else "First", f"Last{i}", 1, "User", "" if i % 2 else "Regular", True) for i, (emp, *_) in enumerate(BOUNDARY)],
    )
    depts = depts_df(spark, [(1, "Ops")])
    rows, log = [], 1
    for emp, first, last, *_ in BOUNDARY:
        rows.append((log, emp, f"2026-01-05 {first}", "GATE", "A1", None))
        log += 1
        if last:
            rows.append((log, emp, f"2026-01-05 {last}", "GATE", "A1", None))
            log += 1
    # an orphan punch (no user) and an unauthorized one
    rows.append((log, "X99", "2026-01-05 10:00:00", "GATE", None, "Unauthorized Entry"))
    rows.append((log + 1, None, "2026-01-05 10:00:00", "GATE", None, None))
    return punches_df(spark, rows), users, depts


def test_report_a_boundaries(tables):
    punches, users, depts = tables
    rec = rows_by(A.daily_attendance(punches, users, depts), "EmployeeID")
    assert set(rec) == {b[0] for b in BOUNDARY}  # orphans dropped by the inner join
    for emp, first, last, status_a, _ in BOUNDARY:
        assert rec[emp]["Status"] == status_a, emp
    assert rec["E03"]["TotalHours"] == "9.01"
    assert rec["E09"]["LastOut"] == "Missing Checkout" and rec["E09"]["TotalHours"] == "-"
    assert rec["E01"]["Weekday"] == "Monday" and rec["E01"]["Date"] == "2026-01-05"
    assert rec["E02"]["Name"] == "NULL Last1"
    assert rec["E02"]["EmpType"] == "Regular"


def test_report_b_boundaries(tables):
    punches, users, depts = tables
    rec = rows_by(B.daily_report_b(punches, users, depts), "EmployeeID")
    for emp, first, last, _, status_b in BOUNDARY:
        assert rec[emp]["Status"] == status_b, emp
    assert rec["E09"]["TotalHours"] == "Not Checked Out" and rec["E09"]["LastOut"] is None
    assert rec["E10"]["TotalHours"] == "Not Checked In" and rec["E10"]["FirstIn"] is None and rec["E10"]["LastOut"] == "1:00 PM"
    assert rec["E03"]["TotalHours"] == "9.01"
    assert rec["E01"]["TotalHours"] == "9" and rec["E01"]["Date"] == "05-01-2026" and rec["E01"]["FirstIn"] == "9:00 AM"
    assert rec["E02"]["FirstName"] == "" and rec["E02"]["Name"] == "Last1"
    assert rec["X99"]["Name"] == "Unauthorized Entry" and rec["X99"]["Status"] == "Unauthorized Entry"
    assert rec["X99"]["Department"] == "Unassigned" and rec["X99"]["EmpType"] == "N/A"
    assert rec["UNKNOWN"]["Name"] == "Unknown Employee"


def test_report_b_filters(tables):
    punches, users, depts = tables
    out = B.daily_report_b(punches, users, depts, from_date="2026-01-05", to_date="2026-01-05", department=" ops ", status="late arrival", search="e0")
    assert sorted(r["EmployeeID"] for r in out.collect()) == ["E04", "E05"]


def test_status_distribution_zero_fill_and_partition(tables):
    punches, users, depts = tables
    rec = A.daily_attendance(punches, users, depts)
    dist = {r["Status"]: r["Count"] for r in A.status_distribution(rec).collect()}
    assert dist == {"ONTIME": 2, "OVERTIME": 2, "LATE_ENTRY_AND_LATE_EXIT": 1, "LATE_ENTRY_AND_EARLY_EXIT": 1, "EARLY_DEPARTURE": 2}
    incomplete = rec.where(F.col("Status") == "Incomplete Record").count()
    assert sum(dist.values()) + incomplete == rec.count()


def test_trend_and_widgets(tables):
    punches, users, depts = tables
    rec = A.daily_attendance(punches, users, depts)
    trend = A.daily_trend(rec).first()
    # mean of 2-decimal hours of the 8 complete records
    assert trend["date"] == "2026-01-05"
    w = D.summary_widgets(rec).first()
    assert (w["total_employees"], w["records"], w["incomplete"]) == (10, 10, 2)
    assert w["avg_hours"] == f"{trend['avgHours']:.2f}"


def test_compliance_and_bands(tables):
    punches, users, depts = tables
    rec = A.daily_attendance(punches, users, depts)
    comp = rows_by(D.employee_summary(rec), "EmployeeID")
    assert comp["E01"]["CompliancePct"] == 100.0 and comp["E01"]["ComplianceBand"] == "success"
    assert comp["E09"]["CompliancePct"] == 0.0 and comp["E09"]["ComplianceBand"] == "danger"
    assert comp["E07"]["LateCount"] == 1 and comp["E07"]["EarlyCount"] == 1
    bands = rows_by(D.time_bands(rec), "EmployeeID")
    assert bands["E04"]["in_band"] == "success" and bands["E05"]["in_band"] == "warning"
    assert bands["E06"]["out_band"] == "warning" and bands["E09"]["hours_band"] == "Incomplete"


def test_page_and_timeline(tables):
    punches, users, depts = tables
    rec = A.daily_attendance(punches, users, depts)
    p1 = [r["EmployeeID"] for r in D.page(rec, 1, 3).collect()]
    assert p1 == ["E01", "E02", "E03"]
    p2 = [r["EmployeeID"] for r in D.page(rec, 1, 2, "TotalHours", "desc").collect()]
    assert p2 == ["E08", "E03"]
    tl = D.timeline(rec.where(F.col("EmployeeID") == "E09")).orderBy("seq").collect()
    assert [r["time"] for r in tl] == ["12:59:59", "Missing checkout registration"]


def test_shuffle_order_independence(spark, tables):
    punches, users, depts = tables
    a = sorted(map(tuple, A.daily_attendance(punches, users, depts).select(*A.RECORD_COLUMNS).collect()))
    b = sorted(map(tuple, A.daily_attendance(punches.repartition(7), users.repartition(3), depts).select(*A.RECORD_COLUMNS).collect()))
    assert a == b


def test_report_b_punch_lists_are_ordered_and_whole(spark, tables):
    punches, users, depts = tables
    rows = [(900 + k, " E01 " if k % 2 else "E01", f"2026-03-02 {(k * 7) % 24:02d}:{(k * 13) % 60:02d}:{k % 60:02d}", "G", None, None) for k in range(60)]
    rows += [(990, "E01", "2026-03-02 00:00:10", "G", None, None), (991, "E01", "2026-03-02 00:00:20", "G", None, None), (992, "", "2026-03-02 12:00:00", "G", None, None)]
    p = punches_df(spark, rows)
    got = {r["EmployeeID"]: r for r in B.daily_report_b(p, users, depts, punch_list=True).collect()}
    times = sorted(r[2] for r in rows if r[1])
    show = lambda t: f"{(int(t[11:13]) + 11) % 12 + 1}:{t[14:16]} {'AM' if int(t[11:13]) < 12 else 'PM'}"
    assert got["E01"]["Punches"] == [show(t) for t in times] and got["E01"]["punch_count"] == 62
    assert got["UNKNOWN"]["Punches"] == ["12:00 PM"]
    assert "Punches" not in B.daily_report_b(p, users, depts).columns


def test_report_b_list_state_is_bounded_by_minutes(spark, tables):
    """A third of all punches on one ID and day: what is collected are minutes, not punches."""
    _, users, depts = tables
    day = spark.range(30_000).select(
        F.col("id").alias("LogID"), F.when(F.col("id") % 3 == 0, "UNKNOWN").otherwise(F.concat(F.lit("X"), F.col("id") % 500)).alias("EmployeeNo"),
        F.expr("TIMESTAMP_NTZ'2026-03-02 00:00:00' + make_dt_interval(0, 0, 0, id % 86400)").alias("PunchDateTime"), F.lit(None).cast("string").alias("Status"))
    groups = B.daily_groups(day, punch_list=True)
    hot = groups.where("EmployeeID = 'UNKNOWN'").select(F.size("runs").alias("runs"), "punch_count").first()
    assert hot.punch_count == 10_000 and hot.runs <= 1440
    rec = B.daily_report_b(day, users, depts, punch_list=True).where("EmployeeID = 'UNKNOWN'").select(F.size("Punches").alias("n"), "FirstIn", F.element_at("Punches", 1).alias("one")).first()
    assert rec.n == 10_000 and rec.one == rec.FirstIn


def test_report_b_counts_once_when_users_repeat(spark, tables):
    punches, users, depts = tables
    twice = users.unionByName(users.withColumn("UserID", (F.col("UserID") + 1000).cast(users.schema["UserID"].dataType)).withColumn("FirstName", F.lit("Later")))
    cols = [*B.RECORD_COLUMNS, "punch_count"]
    a = sorted(map(tuple, B.daily_report_b(punches, users, depts).select(*cols).collect()), key=str)
    assert sorted(map(tuple, B.daily_report_b(punches, twice, depts).select(*cols).collect()), key=str) == a


def test_employee_search_escapes_wildcards(spark):
    users = users_df(spark, [(1, "A_1", "x", "y", 1, "User", None, True), (2, "AB1", "x", "y", 1, "User", None, True)])
    assert sorted(r["EmployeeNo"] for r in A.by_employee(users, "a_1").collect()) == ["A_1"]
    assert sorted(r["EmployeeNo"] for r in A.by_employee(users, "a_1", raw=True).collect()) == ["AB1", "A_1"]
    assert A.by_employee(users, "  ").count() == 2


def test_wildcards_reach_report_a(spark, tables):
    punches, users, depts = tables
    names = lambda **kw: {r["EmployeeID"] for r in A.daily_attendance(punches, users, depts, **kw).collect()}
    every = names()
    assert names(employee="E0_", raw_like=True) == {x for x in every if x.startswith("E0")} and names(employee="E0_") == set()


def test_deep_pages_by_position_equal_the_sorted_pages(spark, tables, monkeypatch):
    punches, users, depts = tables
    rec = A.daily_attendance(punches, users, depts)
    for column, direction in ((None, "asc"), ("TotalHours", "desc"), ("Name", "asc"), ("Date", "desc")):
        want = [D.page(rec, n, 3, column, direction).collect() for n in range(1, 6)]
        with monkeypatch.context() as m:
            m.setattr(D, "TOP_ROWS", 0)
            deep = [D.page(rec, n, 3, column, direction) for n in range(1, 6)]
            assert deep[0].columns == rec.columns
            assert [p.collect() for p in deep] == want
            assert "TakeOrderedAndProject" not in deep[0]._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("search", ["e0", "unauth", "known", " ", "zzz", "a", "E01", "unknown employee"])
def test_search_below_the_aggregate_keeps_every_hit(spark, tables, search):
    punches, users, depts = tables
    cols = list(B.RECORD_COLUMNS)
    whole = B.filter_b(B.daily_report_b(punches, users, depts), search=search).select(*cols).collect()
    got = B.daily_report_b(punches, users, depts, search=search).select(*cols).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, whole), key=str)
