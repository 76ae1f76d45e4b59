import datetime as dt
import os

import pytest
from pyspark.errors import StreamingQueryException

from helpers import users_df
from punchspark.streaming.punch_stream import start_punch_stream


def test_file_stream_ingests_each_upload(spark, tmp_dir):
    inp = os.path.join(tmp_dir, "in")
    os.makedirs(inp)
    header = ["Staff ID", "Date", "Time", "DeviceName", "AreaName"]
    with open(os.path.join(inp, "u1.csv"), "w") as fh:
        fh.write(",".join(header) + "\nEMP001,2026-05-25,09:00,MAIN,L\nEMP001,2026-05-25,09:00,MAIN,L\nXX,2026-05-25,10:00,MAIN,L\n")
    with open(os.path.join(inp, "u2.csv"), "w") as fh:
        fh.write(",".join(header) + "\nEMP001,2026-05-25,18:00,SERVER ROOM-IN,L\nEMP001,2026-05-25,18:05,MAIN,L\n")
    users = users_df(spark, [(1, "EMP001", "John", "Smith", 1, "User", None, True)])
    out, met, ck = (os.path.join(tmp_dir, x) for x in ("punches", "metrics", "ck"))
    q = start_punch_stream(spark, inp, header, lambda s: users, out, met, ck)
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    assert got.count() == 3
    m = spark.read.parquet(met).agg({"importedRows": "sum", "skippedDuplicates": "sum", "unauthorizedRecords": "sum"}).first()
    assert (m[0], m[1], m[2]) in ((3, 1, 1),) or sorted([m[0], m[1], m[2]]) == [1, 1, 3]


def test_cross_file_dedup(spark, tmp_dir):
    inp = os.path.join(tmp_dir, "in2")
    os.makedirs(inp)
    header = ["Staff ID", "Date", "Time", "DeviceName", "AreaName"]
    for name in ("a.csv", "b.csv"):  # the same export uploaded twice
        with open(os.path.join(inp, name), "w") as fh:
            fh.write(",".join(header) + "\nEMP001,2026-05-25,09:00,MAIN,L\nEMP001,2026-05-25,18:00,MAIN,L\n")
    users = users_df(spark, [(1, "EMP001", "John", "Smith", 1, "User", None, True)])
    out, met, ck = (os.path.join(tmp_dir, x) for x in ("p2", "m2", "c2"))
    q = start_punch_stream(spark, inp, header, lambda s: users, out, met, ck, cross_file_dedup=True)
    q.awaitTermination(120)
    assert spark.read.parquet(out).count() == 2


def test_late_uploads_are_stored_and_replays_are_not(spark, tmp_dir):
    inp = os.path.join(tmp_dir, "in3")
    os.makedirs(inp)
    header = ["Staff ID", "Date", "Time", "DeviceName", "AreaName"]
    users = users_df(spark, [(1, "EMP001", "John", "Smith", 1, "User", None, True)])
    out, met = (os.path.join(tmp_dir, x) for x in ("p3", "m3"))

    def upload(name, month, ck):
        if name:
            with open(os.path.join(inp, name), "w") as fh:
                fh.write(",".join(header) + f"\nEMP001,2026-{month}-25,09:00,MAIN,L\nEMP001,2026-{month}-25,18:00,MAIN,L\n")
        start_punch_stream(spark, inp, header, lambda s: users, out, met, os.path.join(tmp_dir, ck), cross_file_dedup=True).awaitTermination(120)
        return spark.read.parquet(out).count()

    assert upload("may.csv", "05", "c3") == 2
    assert upload("april.csv", "04", "c3") == 4
    assert upload(None, None, "c3-new") == 4  # both files again, in one batch


def test_replayed_batch_replaces_itself(spark, tmp_dir):
    inp = os.path.join(tmp_dir, "in4")
    os.makedirs(inp)
    header = ["Staff ID", "Date", "Time", "DeviceName", "AreaName"]
    with open(os.path.join(inp, "a.csv"), "w") as fh:
        fh.write(",".join(header) + "\nEMP001,2026-05-25,09:00,MAIN,L\n")
    users = users_df(spark, [(1, "EMP001", "John", "Smith", 1, "User", None, True)])
    for ck in ("c4", "c4-lost"):  # a lost checkpoint replays the batch
        start_punch_stream(spark, inp, header, lambda s: users, os.path.join(tmp_dir, "p4"), os.path.join(tmp_dir, "m4"), os.path.join(tmp_dir, ck)).awaitTermination(120)
    assert spark.read.parquet(os.path.join(tmp_dir, "p4")).count() == 1


def test_swapped_header_is_rejected(spark, tmp_dir):
    inp = os.path.join(tmp_dir, "in5")
    os.makedirs(inp)
    with open(os.path.join(inp, "a.csv"), "w") as fh:
        fh.write("Staff ID,Date,Time,AreaName,DeviceName\nEMP001,2026-05-25,09:00,Lobby,SERVER ROOM-IN\n")
    users = users_df(spark, [(1, "EMP001", "John", "Smith", 1, "User", None, True)])
    q = start_punch_stream(spark, inp, ["Staff ID", "Date", "Time", "DeviceName", "AreaName"], lambda s: users, *(os.path.join(tmp_dir, x) for x in ("p5", "m5", "c5")))
    with pytest.raises(StreamingQueryException):
        q.awaitTermination(120)


def test_dedup_reads_the_dates_of_the_batch_only(spark, tmp_dir, capsys):
    """Late and repeated punches against a table of many dates; the scan is given the batch's dates."""
    from punchspark.sources.sinks import append_punches
    from punchspark.streaming import punch_stream as S

    path = f"{tmp_dir}/punches"
    at = lambda day, hour: dt.datetime(2026, 1, day, hour)
    frame = lambda rows: spark.createDataFrame([(e, t, "G", None, None) for e, t in rows], "EmployeeNo string, PunchDateTime timestamp_ntz, DeviceName string, AreaName string, Status string")
    assert S.new_punches(frame([("E1", at(1, 9))] * 2), path, "x").count() == 1
    append_punches(frame([("E1", at(d, 9)) for d in range(1, 20)]), path, "old")
    batch = frame([("E1", at(3, 9)), ("E1", at(3, 10)), ("E2", at(3, 9)), ("E1", at(25, 9)), ("E1", at(25, 9)), (None, at(4, 9))])
    new = S.new_punches(batch, path, "new")
    assert sorted((r.EmployeeNo or "", r.PunchDateTime) for r in new.collect()) == [("", at(4, 9)), ("E1", at(3, 10)), ("E1", at(25, 9)), ("E2", at(3, 9))]
    read = S.stored_on_dates_of(batch, spark.read.parquet(path))
    read.explain("formatted")
    filters = [x for x in capsys.readouterr().out.splitlines() if x.startswith("PartitionFilters")]
    assert len(filters) == 1 and all(f"2026-01-{d:02d}" in filters[0] for d in (3, 4, 25)) and "2026-01-05" not in filters[0]
    append_punches(new, path, "new")
    assert S.new_punches(batch, path, "new").count() == 4  # its own load is not held against it
    assert S.new_punches(batch, path, "third").where("EmployeeNo is not null").count() == 0


def test_stream_takes_files_of_any_layout(spark, tmp_dir):
    """Columns in another order, under other names, and too many of them; each file by its own header."""
    inp = os.path.join(tmp_dir, "in")
    os.makedirs(inp)
    for name, text in {
        "a.csv": "Staff ID,Date,Time,DeviceName\nE1,2026-05-25,09:00,MAIN\nE1,2026-05-25,09:00,MAIN\n",
        "b.CSV": "Time,DeviceName,PersonNo,DATE,Note\n10:00,\"GATE, 2\",e1,25-05-2026,x\n\n11:00,SERVER ROOM-IN,E1,25-05-2026,\n",
        "empty.csv": "",
        "c.csv": "Date,Time,PersonNo\n2026-05-26,12:00,NOBODY,and,more,cells\n",
    }.items():
        with open(os.path.join(inp, name), "w") as fh:
            fh.write(text)
    users = users_df(spark, [(1, "E1", "John", "Smith", 1, "User", None, True)])
    out, met, ck = (os.path.join(tmp_dir, x) for x in ("punches", "metrics", "ck"))
    for _ in range(2):  # the second run finds nothing new
        start_punch_stream(spark, inp, None, lambda s: users, out, met, ck).awaitTermination()
        got = sorted((r.EmployeeNo, str(r.PunchDateTime), r.DeviceName) for r in spark.read.parquet(out).collect())
        assert got == [("E1", "2026-05-25 09:00:00", "MAIN"), ("E1", "2026-05-25 10:00:00", "GATE, 2"), ("NOBODY", "2026-05-26 12:00:00", None)]
