import os
import subprocess
import sys

from punchspark.__main__ import main


def test_cli_end_to_end(spark, tmp_dir):
    wh, rin, pin, out = (os.path.join(tmp_dir, x) for x in ("wh", "rin", "pin", "out"))
    os.makedirs(rin)
    os.makedirs(pin)
    assert main(["init", "--warehouse", wh, "--departments", "IT,HR"]) == {"departments": 2}
    with open(os.path.join(rin, "roster.csv"), "w") as fh:
        fh.write("Staff No.,First Name,Last Name,Department,Emp.Type\nE1,Jane,Roe,HR,Perm\nE2,John,Smith,Ops,\n")
    m = main(["roster", "--warehouse", wh, "--input", rin])
    assert (m["importedRows"], m["autoProvisionedUsers"], m["autoProvisionedDepartments"]) == (2, 2, 1)
    with open(os.path.join(pin, "p.csv"), "w") as fh:
        fh.write("PersonNo,PersonFirstName,PersonLastName,DATE,TIME,DeviceName\nE1,Jane,Roe,05-01-2026,09:00,G\nE1,Jane,Roe,05-01-2026,18:30,G\n0,John,Smith,05-01-2026,09:20,G\n")
    p = main(["punches", "--warehouse", wh, "--input", pin])
    assert (p["importedRows"], p["unauthorizedRecords"]) == (3, 0)
    d = main(["dashboard", "--warehouse", wh, "--out", os.path.join(out, "dash")])
    assert d["records"] == 2
    # E2 has one punch before 13:00: report B calls it an early departure, not checked out
    e = main(["export", "--warehouse", wh, "--out", os.path.join(out, "exp"), "--format", "csv", "--status", "early departure"])
    assert e["success"]
    text = "".join(open(os.path.join(e["path"], f)).read() for f in os.listdir(e["path"]) if f.endswith(".csv"))
    rows = text.strip().split("\n")[1:]
    assert len(rows) == 1 and rows[0].startswith('"E2","John","Smith","Ops","05-01-2026","Monday","9:20 AM",')
    assert rows[0].endswith('"Not Checked Out","Early Departure"')
    names = [x["DepartmentName"] for x in main(["departments", "--warehouse", wh])["departments"]]
    assert names == ["HR", "IT", "Ops"]


def test_cli_users_and_stream(spark, tmp_dir):
    wh = os.path.join(tmp_dir, "wh")
    main(["init", "--warehouse", wh, "--departments", "IT"])
    req = os.path.join(tmp_dir, "req.csv")
    with open(req, "w") as fh:
        fh.write("employeeNo,firstName,lastName,departmentId,role,password\n e7 ,Ann,Lee,1,User,pw\nE8,,Roe,1,User,pw\n")
    out = main(["users", "--warehouse", wh, "--action", "create", "--input", req])
    assert out["rejected"] == 1
    assert [r["employeeNo"] for r in spark.read.parquet(out["rejects"]).collect()] == ["E8"]
    act = os.path.join(tmp_dir, "act.csv")
    with open(act, "w") as fh:
        fh.write("employeeNo,isActive\nE7,false\n")
    main(["users", "--warehouse", wh, "--action", "active", "--input", act])
    from punchspark.sources import tables

    u = {r["EmployeeNo"]: r for r in tables.users(spark, wh).collect()}
    assert u["E7"]["IsActive"] is False and u["E7"]["FirstName"] == "Ann"
    sin = os.path.join(tmp_dir, "sin")
    os.makedirs(sin)
    with open(os.path.join(sin, "a.csv"), "w") as fh:
        fh.write("Staff ID,Date,Time,DeviceName\nE7,2026-05-25,09:00,G\nE7,2026-05-25,18:00,G\n")
    assert main(["stream", "--warehouse", wh, "--input", sin, "--header", "Staff ID,Date,Time,DeviceName"]) == {"stream": "done"}
    assert tables.punches(spark, wh).count() == 2


def test_submitted_settings_are_kept(tmp_dir):
    code = "from punchspark.__main__ import _session as s; x = s(); print('GOT', x.sparkContext.master, x.conf.get('spark.sql.shuffle.partitions'))"
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.sql.shuffle.partitions=400 --conf spark.ui.enabled=false pyspark-shell"}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert "GOT local[2] 400" in done.stdout
