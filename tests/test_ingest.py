"""Punch ingestion on the reference's scratch scenarios (expected values follow the code)."""

from helpers import rows_by, upload_df, users_df
from punchspark.operators.ingest import ingest_punch_upload


def roster(spark):
    return users_df(
        spark,
        [
            (1, "EMP001", "John", "Smith", 1, "User", None, True),
            (2, "EMP002", "Mary Ann", "Lee", 1, "User", None, True),
            (3, "EMP003", "", "Kumar", 1, "User", None, True),
            (4, "EMP004", "Rajesh", "Kumar", 1, "User", None, True),
        ],
    )


def test_short_layout_unknown_id_is_stored_unauthorized(spark):
    up = upload_df(
        spark,
        ["Staff ID", "Date", "Time", "DeviceName", "AreaName"],
        [
            ["emp001", "2026-05-25", "09:00", "MAIN-IN", "Lobby"],
            ["EMP001", "2026-05-25", "18:00", "MAIN-OUT", "Lobby"],
            ["EMP002", "25-05-2026", "09:05", "MAIN-IN", ""],
            ["ZZ999", "2026-05-25", "09:30", "MAIN-IN", "Lobby"],
        ],
    )
    res = ingest_punch_upload(up, roster(spark))
    stored = res.punches.collect()
    m = res.metrics.first()
    assert len(stored) == 4
    assert sum(r["Status"] == "Unauthorized Entry" for r in stored) == 1
    assert (m["importedRows"], m["skippedDuplicates"], m["unauthorizedRecords"], m["autoProvisionedUsers"]) == (4, 0, 1, 0)
    assert {r["EmployeeNo"] for r in stored} == {"EMP001", "EMP002", "ZZ999"}
    assert [r["AreaName"] for r in stored if r["EmployeeNo"] == "EMP002"] == [None]


def test_facility_doors_are_dropped(spark):
    header = ["S.No", "Seq ID", "DATE", "TIME", "PersonFirstName", "PersonLastName", "PersonNo", "DeviceName", "AreaName", "Department"]
    devs = ["MAIN-IN", "SERVER ROOM-IN", "SERVER ROOM-OUT", "HUB ROOM-IN", "MAIN-OUT", " CANTEEN "]
    rows = [[str(i), str(i), "2026-05-25", f"{9 + i}:00", "John", "Smith", "EMP001", d, "A", "IT"] for i, d in enumerate(devs)]
    res = ingest_punch_upload(upload_df(spark, header, rows), roster(spark))
    got = sorted(r["DeviceName"] for r in res.punches.collect())
    assert got == ["CANTEEN", "MAIN-IN", "MAIN-OUT"]


def test_full_layout_duplicate_and_no_user_creation(spark):
    header = ["S.No", "Seq ID", "EventTypeId", "DATE", "TIME", "DeviceName", "PersonLastName", "PersonFirstName", "PersonNo", "CredentialNo", "AreaName", "Department"]
    rows = [
        ["1", "1", "1", "2026-05-25", "09:00:00", "D1", "Smith", "John", "EMP001", "c", "A", "IT"],
        ["2", "2", "1", "2026-05-25", "09:00:00", "D2", "Smith", "John", "EMP001", "c", "A", "IT"],
        ["3", "3", "1", "2026-05-25", "18:00:00", "D1", "Smith", "John", "EMP001", "c", "A", "IT"],
        ["4", "4", "1", "2026-05-25", "09:10:00", "D1", "New", "Person", "NEW1", "c", "A", "HR"],
        ["5", "5", "1", "2026-05-25", "09:20:00", "D1", "Other", "Person", "NEW2", "c", "A", "HR"],
        ["6", "6", "1", "2026-05-25", "17:20:00", "D1", "Lee", "Mary Ann", "EMP002", "c", "A", "IT"],
    ]
    res = ingest_punch_upload(upload_df(spark, header, rows), roster(spark))
    m = res.metrics.first()
    assert (m["importedRows"], m["skippedDuplicates"], m["autoProvisionedUsers"], m["autoProvisionedDepartments"]) == (5, 1, 0, 0)
    kept = [r for r in res.punches.collect() if r["EmployeeNo"] == "EMP001" and r["PunchDateTime"].hour == 9]
    assert len(kept) == 1 and kept[0]["DeviceName"] == "D1"  # first row in file order wins


def test_name_cascade(spark):
    header = ["PersonNo", "PersonFirstName", "PersonLastName", "Date", "Time", "DeviceName"]
    rows = [
        ["0", "JOHN", "SMITH 123", "2026-05-25", "09:00", "D"],  # exact
        ["", "Smith", "John", "2026-05-25", "09:01", "D"],  # exact (reversed key exists)
        ["NULL", "Lee", "X Mary", "2026-05-25", "09:02", "D"],  # 'Lee Mary': no exact/word key; loose 'lee' ⊂ 'maryannlee'
        ["16777985", "Raj", "K.", "2026-05-25", "09:03", "D"],  # loose: no, 'raj' length 3 → first key containing 'raj'
        ["0", "Kumar", "", "2026-05-25", "09:04", "D"],  # exact: key 'kumar' (EMP003 has last name only)
        ["", "", "", "2026-05-25", "09:05", "D"],  # nothing → NOT PROVIDED
        ["0", "Zed", "Unknown", "2026-05-25", "09:06", "D"],  # no match → keeps dummy ID
    ]
    res = ingest_punch_upload(upload_df(spark, header, rows), roster(spark))
    got = {r["PunchDateTime"].minute: (r["EmployeeNo"], r["match_method"], r["Status"]) for r in res.punches.collect()}
    assert got[0] == ("EMP001", "exact", None)
    assert got[1] == ("EMP001", "exact", None)
    assert got[3] == ("EMP004", "loose", None)
    assert got[4] == ("EMP003", "exact", None)
    assert got[5] == ("NOT PROVIDED", "none", "Unauthorized Entry")
    assert got[6] == ("0", "none", "Unauthorized Entry")
    assert got[2] == ("EMP002", "loose", None)


def test_words_pairs(spark):
    users = users_df(spark, [(1, "A1", "Anil", "Kapoor", 1, "User", None, True)])
    header = ["PersonNo", "PersonFirstName", "PersonLastName", "Date", "Time", "DeviceName"]
    rows = [
        ["0", "Anil Kumar", "Kapoor", "2026-05-25", "09:00", "D"],  # w1+wN = anilkapoor
        ["0", "Kapoor", "Anil Sharma", "2026-05-25", "09:01", "D"],  # w2+w1 = anilkapoor
    ]
    got = {r["PunchDateTime"].minute: (r["EmployeeNo"], r["match_method"]) for r in ingest_punch_upload(upload_df(spark, header, rows), users).punches.collect()}
    assert got == {0: ("A1", "words"), 1: ("A1", "words")}


def test_excel_serial_upload(spark):
    header = ["S.No", "Seq ID", "DATE", "TIME", "PersonFirstName", "PersonLastName", "PersonNo", "DeviceName", "AreaName", "Department"]
    rows = [["1", "1", "45992", "0.385417", "John", "Smith", "EMP001", "D", "A", "IT"], ["2", "2", "45992", "0.753472", "John", "Smith", "EMP001", "D", "A", "IT"]]
    got = sorted(r["PunchDateTime"].strftime("%Y-%m-%d %H:%M") for r in ingest_punch_upload(upload_df(spark, header, rows), roster(spark)).punches.collect())
    assert got == ["2025-12-01 09:15", "2025-12-01 18:05"]
