import os

import pytest
from pyspark.sql import functions as F

from helpers import punches_df, users_df, depts_df
from punchspark.operators import report_b as B
from punchspark.operators.ingest import ingest_punch_upload
from punchspark.sources import sinks, tables, uploads
from punchspark.sources.workbook import read_workbooks, write_xlsx


def write(path, text):
    with open(path, "w", newline="") as fh:
        fh.write(text)


def test_mixed_layout_csv_uploads_and_header_check(spark, tmp_dir):
    d = os.path.join(tmp_dir, "in")
    os.makedirs(d)
    write(os.path.join(d, "a.csv"), "Staff ID,Date,Time,DeviceName,AreaName\nEMP001,2026-05-25,09:00,MAIN,L\nEMP001,2026-05-25,18:00,MAIN,L\n")
    write(os.path.join(d, "b.csv"), 'PersonNo,PersonFirstName,PersonLastName,DATE,TIME,DeviceName\n0,"John","Smith",25-05-2026,09:30,GATE\n')
    write(os.path.join(d, "c.csv"), "EmployeeID,Name,Department,Timestamp\n")
    heads = uploads.upload_headers(spark, d)
    chk = {os.path.basename(r["upload_id"]): (r["valid"], sorted(r["missing"])) for r in uploads.check_uploads(heads).collect()}
    assert chk["c.csv"] == (True, [])
    assert chk["a.csv"][0] is False and "EmployeeID" in chk["a.csv"][1]
    users = users_df(spark, [(1, "EMP001", "John", "Smith", 1, "User", None, True)])
    stored = ingest_punch_upload(uploads.read_csv_uploads(spark, d), users).punches.collect()
    assert len(stored) == 3 and all(r["EmployeeNo"] == "EMP001" for r in stored)


def test_workbook_reader_keeps_serials(spark, tmp_dir):
    p = os.path.join(tmp_dir, "w.xlsx")
    header = ["S.No", "Seq ID", "DATE", "TIME", "PersonFirstName", "PersonLastName", "PersonNo", "DeviceName", "AreaName", "Department"]
    write_xlsx(p, header, [[1, 1, 45992, 0.385417, "John", "Smith", "EMP001", "D", "A", "IT"], [2, 2, 45992, 0.753472, "John", "Smith", "EMP001", "D", "", "IT"]])
    wb = read_workbooks(spark, tmp_dir)
    cells = [r["cells"] for r in wb.collect()]
    assert cells[0]["date"] == "45992" and cells[0]["time"] == "0.385417" and cells[1]["areaname"] == ""
    users = users_df(spark, [(1, "EMP001", "John", "Smith", 1, "User", None, True)])
    punches = ingest_punch_upload(wb, users).punches
    depts = depts_df(spark, [(1, "IT")])
    p2 = punches.select(F.lit(1).cast("long").alias("LogID"), "EmployeeNo", "PunchDateTime", "DeviceName", "AreaName", "Status")
    rec = B.daily_report_b(p2, users, depts).first()
    assert (rec["Date"], rec["Weekday"], rec["FirstIn"], rec["LastOut"]) == ("01-12-2025", "Monday", "9:15 AM", "6:05 PM")


def test_csv_report_sink(spark, tmp_dir):
    users = users_df(spark, [(1, "E1", 'Jo "J"', "Doe", 1, "User", None, True)])
    punches = punches_df(spark, [(1, "E1", "2026-01-05 09:00:00", "G", None, None), (2, "E1", "2026-01-05 18:00:00", "G", None, None)])
    rep = B.daily_report_b(punches, users, depts_df(spark, [(1, "Ops")]))
    out = os.path.join(tmp_dir, "report")
    sinks.write_report_csv(rep, out)
    text = "".join(open(os.path.join(out, f)).read() for f in sorted(os.listdir(out)) if f.endswith(".csv"))
    lines = text.strip().split("\n")
    assert lines[0].startswith('"Employee ID","First Name"')
    assert lines[1] == '"E1","Jo ""J""","Doe","Ops","05-01-2026","Monday","9:00 AM","6:00 PM","9","Compliant"'


def test_audit_lines(spark):
    ev = spark.createDataFrame(
        [("2026-01-05 10:00:00", "Jane", "jdoe", "excel", {"status": "OVERTIME"})],
        "ts string, name string, username string, format string, filters map<string,string>",
    )
    assert sinks.export_audit_lines(ev).first()["value"] == '[2026-01-05 10:00:00] USER: Jane (ADID: jdoe) | ACTION: Export EXCEL | FILTERS: {"status":"OVERTIME"}'
    se = spark.createDataFrame(
        [("t", "LOGIN", "E1", "Jane", "User", None), ("t", "LOGIN", "E1", "Jane", "User", "FAILED")],
        "ts string, action string, user_id string, name string, role string, status string",
    )
    got = [r["value"] for r in sinks.session_audit_lines(se).collect()]
    assert got == ["[t] ACTION: LOGIN | User ID: E1 | Name: Jane | Role: User", "[t] ACTION: LOGIN | User ID: E1 | Name: Jane | Role: User | Status: FAILED"]


def test_append_punches_partitioned_and_read_back(spark, tmp_dir):
    wh = os.path.join(tmp_dir, "wh")
    punches = punches_df(spark, [(1, "E1", "2026-01-05 09:00:00", "G", None, None), (2, "E1", "2026-01-06 18:00:00", "G", None, "Unauthorized Entry")])
    sinks.append_punches(punches, os.path.join(wh, "punches"))
    back = tables.punches(spark, wh)
    ids = [r["LogID"] for r in back.collect()]
    assert len(ids) == 2 and None not in ids and len(set(ids)) == 2
    parts = sorted(x for x in os.listdir(os.path.join(wh, "punches")) if x.startswith("punch_date="))
    assert parts == ["punch_date=2026-01-05", "punch_date=2026-01-06"]
    tables.write_new_version(users_df(spark, [(1, "E1", "A", "B", 1, "User", None, True)]), wh, "users")
    assert tables.users(spark, wh).count() == 1


def test_bom_header_and_unicode_spaces(spark, tmp_dir):
    """Excel writes a byte-order mark before the first header; JS whitespace rules ignore it,
    and treat no-break spaces in names as spaces."""
    d = os.path.join(tmp_dir, "bom")
    os.makedirs(d)
    with open(os.path.join(d, "a.csv"), "w", encoding="utf-8-sig") as fh:
        fh.write("PersonNo,PersonFirstName,PersonLastName,Date,Time\nEMP001,x,y,2026-05-25,09:00\n0,John , Smith,2026-05-25,10:00\n")
    users = users_df(spark, [(1, "EMP001", "John", "Smith", 1, "User", None, True)])
    stored = ingest_punch_upload(uploads.read_csv_uploads(spark, d), users).punches.collect()
    got = sorted((r["EmployeeNo"], r["match_method"]) for r in stored)
    assert got == [("EMP001", "exact"), ("EMP001", "id")]


def test_no_row_of_an_odd_upload_is_lost(spark, tmp_dir):
    """Latin-1 bytes, upper-case extension, headers that differ in case, repeated and blank headers, quoted line breaks."""
    from punchspark.plans.upload import upload_frames

    d = os.path.join(tmp_dir, "odd")
    os.makedirs(d)
    with open(os.path.join(d, "latin.csv"), "wb") as fh:
        fh.write("PersonNo,Name,Date,Time,Gerät\nE1,x,2026-05-25,09:00,Ä\n".encode("latin-1"))
    write(os.path.join(d, "UP.CSV"), "PersonNo,Date,DATE,Time,,Time\nE1,2026-05-25,1999-01-01,10:00,?,23:59\nE1,2026-05-26,,11:00\n")
    write(os.path.join(d, "lines.csv"), 'PersonNo,Name,Date,Time\nE1,"a\nb",2026-05-27,12:00\n')
    users = users_df(spark, [(1, "E1", "John", "Smith", 1, "User", None, True)])
    (frame,) = upload_frames(spark, d, multi_line=True)
    got = sorted(str(r["PunchDateTime"]) for r in ingest_punch_upload(frame, users).punches.collect())
    assert got == ["2026-05-25 09:00:00", "2026-05-25 10:00:00", "2026-05-26 11:00:00", "2026-05-27 12:00:00"]
    write(os.path.join(d, "notes.txt"), "x")
    for path in (d, os.path.join(tmp_dir, "none")):
        os.makedirs(path, exist_ok=True)
        with pytest.raises(ValueError):
            upload_frames(spark, path)


def test_one_wide_line_says_nothing_about_other_files(spark, tmp_dir):
    """A quoted cell of 25,000 commas, a line of 25,000 cells, stray and doubled quotes, short lines, blank lines."""
    d = os.path.join(tmp_dir, "wide")
    os.makedirs(d)
    write(os.path.join(d, "a.csv"), "PersonNo,Date,Time\n\nE1,2026-05-25,09:00\nE2\n" + "E3" + "," * 25_000 + "\n")
    write(os.path.join(d, "b.csv"), 'PersonNo,Name,Date\nE4,"' + "," * 25_000 + '",x\nE5,a"b,"c""d"\n  \n,"",z\nE6,"open,y\n')
    for multi_line in (False, True):
        rows = uploads.read_csv_uploads(spark, d, multi_line).orderBy("upload_id", "row_ord").collect()
        got = [(os.path.basename(r["upload_id"]), r["cells"]) for r in rows]
        assert got == [
            ("a.csv", {"personno": "E1", "date": "2026-05-25", "time": "09:00"}),
            ("a.csv", {"personno": "E2", "date": None, "time": None}),
            ("a.csv", {"personno": "E3", "date": None, "time": None}),
            ("b.csv", {"personno": "E4", "name": "," * 25_000, "date": "x"}),
            ("b.csv", {"personno": "E5", "name": 'a"b', "date": 'c"d'}),
            ("b.csv", {"personno": None, "name": "", "date": "z"}),
            ("b.csv", {"personno": "E6", "name": '"open', "date": "y"}),
        ]


def test_workbook_zero_is_blank_except_as_a_time(spark, tmp_dir):
    header = ["PersonNo", "Staff ID", "Date", "Time"]
    write_xlsx(os.path.join(tmp_dir, "w.XLSX"), header, [[0, "EMP001", 45992, 0], [0, "", 45992, 0.5], [0, "EMP001", 0, 0.5]])
    cells = [r["cells"] for r in read_workbooks(spark, tmp_dir).collect()]
    assert [c["personno"] for c in cells] == ["", "", ""] and cells[0]["time"] == "0" and cells[2]["date"] == ""
    users = users_df(spark, [(1, "EMP001", "John", "Smith", 1, "User", None, True)])
    got = ingest_punch_upload(read_workbooks(spark, tmp_dir), users).punches.collect()
    assert sorted((r["EmployeeNo"], str(r["PunchDateTime"])) for r in got) == [("EMP001", "2025-12-01 00:00:00"), ("NOT PROVIDED", "2025-12-01 12:00:00")]


def test_table_stays_readable_between_pointer_steps(spark, tmp_dir):
    wh = os.path.join(tmp_dir, "wh")
    one = users_df(spark, [(1, "E1", "A", "B", 1, "User", None, True)])
    tables.write_new_version(one, wh, "users")
    one.union(one).write.parquet(os.path.join(wh, "users", "v-crashed"))  # written, never pointed at
    assert tables.users(spark, wh).count() == 1
    tables.write_new_version(one.union(one), wh, "users")
    assert tables.users(spark, wh).count() == 2


def test_appends_write_about_one_file_per_date_and_replays_add_nothing(spark, tmp_dir):
    path = os.path.join(tmp_dir, "p")
    many = spark.range(2000).selectExpr("id as LogID", "'E' as EmployeeNo", "timestamp_ntz'2026-01-01 09:00:00' + make_dt_interval(cast(id % 10 as int)) as PunchDateTime", "'' as DeviceName", "'' as AreaName", "'' as Status").repartition(32)
    for _ in range(2):
        sinks.append_punches(many, path, "upload-1")
    assert spark.read.parquet(path).count() == 2000
    assert sum(f.endswith(".parquet") for _, _, fs in os.walk(path) for f in fs) <= 20


def test_csv_lines_are_those_of_the_written_report(spark, tmp_dir):
    cells = {c: "x" for c in sinks.REPORT_FIELDS} | {"FirstName": 'A "B"', "LastName": None, "Department": "R, D", "TotalHours": ""}
    report = spark.createDataFrame([tuple(cells.values())], ", ".join(f"{c} string" for c in cells))
    path = os.path.join(tmp_dir, "lines")
    sinks.write_report_csv(report, path)
    written = [r["value"] for r in spark.read.text(path).collect() if not r["value"].startswith('"Employee ID"')]
    assert [r["line"] for r in sinks.report_csv_lines(report).collect()] == written


def test_log_ids_survive_a_replay(spark, tmp_dir):
    punches = punches_df(spark, [(1, "E1", "2026-01-05 09:00:00", "G", None, None), (2, "E2", "2026-01-05 09:00:00", "G", None, None)])
    ids = []
    for _ in range(2):
        sinks.append_punches(punches, os.path.join(tmp_dir, "replay", "punches"), "one")
        ids.append(sorted(r["LogID"] for r in tables.punches(spark, os.path.join(tmp_dir, "replay")).collect()))
    assert ids[0] == ids[1] and len(set(ids[0])) == 2
