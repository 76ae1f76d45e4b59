import os

import pytest

from helpers import depts_df, punches_df, users_df
from punchspark.plans.dashboard import dashboard_bundle
from punchspark.plans.export import ExportError, export_report
from punchspark.plans.upload import ingest_punch_files, sync_roster_files
from punchspark.sources import tables


def small(spark):
    users = users_df(spark, [(1, "E1", "A", "B", 1, "User", None, True), (2, "E2", "C", "D", 2, "User", "Intern", True)])
    depts = depts_df(spark, [(1, "IT"), (2, "HR")])
    punches = punches_df(
        spark,
        [
            (1, "E1", "2026-01-05 09:00:00", "G", None, None),
            (2, "E1", "2026-01-05 19:00:00", "G", None, None),
            (3, "E2", "2026-01-05 09:30:00", "G", None, None),
            (4, "E2", "2026-01-05 17:00:00", "G", None, None),
            (5, "E2", "2026-01-06 08:00:00", "G", None, None),
        ],
    )
    return punches, users, depts


def test_dashboard_bundle(spark):
    punches, users, depts = small(spark)
    d = dashboard_bundle(punches, users, depts)
    try:
        assert d.records.count() == 3
        dist = {r["Status"]: r["Count"] for r in d.distribution.collect()}
        assert dist["OVERTIME"] == 1 and dist["LATE_ENTRY_AND_EARLY_EXIT"] == 1 and sum(dist.values()) == 2
        assert {r["date"]: r["avgHours"] for r in d.trend.collect()} == {"2026-01-05": 8.75}
        assert d.summary.first()["incomplete"] == 1
    finally:
        d.release()
    empty = dashboard_bundle(punches.limit(0), users, depts)
    assert empty.records.count() == 0 and empty.trend.count() == 0
    assert {r["Count"] for r in empty.distribution.collect()} == {0}


def test_export_formats(spark, tmp_dir):
    punches, users, depts = small(spark)
    audit = os.path.join(tmp_dir, "audit")
    res = export_report(spark, punches, users, depts, "csv", tmp_dir, audit, "Jane", "jdoe", status="Overtime")
    files = [f for f in os.listdir(res["path"]) if f.endswith(".csv")]
    lines = "".join(open(os.path.join(res["path"], f)).read() for f in files).strip().split("\n")
    assert len(lines) == 2 and '"Overtime"' in lines[1]
    assert export_report(spark, punches, users, depts, "pdf", tmp_dir, audit)["success"]
    with pytest.raises(ExportError):
        export_report(spark, punches, users, depts, "docx", tmp_dir, audit)
    with pytest.raises(ExportError):
        export_report(spark, punches, users, depts, None, tmp_dir, audit)
    logged = spark.read.text(audit).collect()
    assert len(logged) == 3 and any("ACTION: Export CSV" in r["value"] for r in logged)


def test_upload_plans_end_to_end(spark, tmp_dir):
    wh = os.path.join(tmp_dir, "wh")
    tables.write_new_version(users_df(spark, [(1, "ADMIN", "System", "Admin", 1, "Admin", None, True)]), wh, "users")
    tables.write_new_version(depts_df(spark, [(1, "IT")]), wh, "departments")
    rdir = os.path.join(tmp_dir, "roster")
    os.makedirs(rdir)
    with open(os.path.join(rdir, "r1.csv"), "w") as fh:
        fh.write("Staff No.,Name,Department,Emp.Type\nE1,Jane Roe,HR,Perm\n")
    with open(os.path.join(rdir, "r2.csv"), "w") as fh:
        fh.write("Staff No.,First Name,Last Name,Department\nE2,John,Smith,it\nE1,Janet,Roe,HR\n")
    m = sync_roster_files(spark, rdir, wh).first()
    assert (m["importedRows"], m["autoProvisionedUsers"], m["autoProvisionedDepartments"], m["skippedDuplicates"]) == (3, 2, 1, 1)
    u = {r["EmployeeNo"]: r for r in tables.users(spark, wh).collect()}
    assert u["E1"]["FirstName"] == "Janet" and u["E2"]["DepartmentID"] == 1 and u["E1"]["UserID"] == 2
    pdir = os.path.join(tmp_dir, "punch")
    os.makedirs(pdir)
    with open(os.path.join(pdir, "p1.csv"), "w") as fh:
        fh.write("Staff ID,Date,Time,DeviceName\nE1,2026-05-25,09:00,G\nE1,2026-05-25,09:00,G\nE9,2026-05-25,10:00,G\n")
    from punchspark.sources.workbook import write_xlsx

    write_xlsx(os.path.join(pdir, "p2.xlsx"), ["PersonNo", "PersonFirstName", "PersonLastName", "DATE", "TIME", "DeviceName"], [["0", "John", "Smith", 45992, 0.385417, "G"]])
    met = ingest_punch_files(spark, pdir, wh).collect()
    tot = {k: sum(r[k] for r in met) for k in ("importedRows", "skippedDuplicates", "unauthorizedRecords")}
    assert tot == {"importedRows": 3, "skippedDuplicates": 1, "unauthorizedRecords": 1}
    stored = {(r["EmployeeNo"], r["PunchDateTime"].strftime("%Y-%m-%d %H:%M")) for r in tables.punches(spark, wh).collect()}
    assert ("E2", "2025-12-01 09:15") in stored and len(stored) == 3
