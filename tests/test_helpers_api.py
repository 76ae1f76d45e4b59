"""Smaller public operators: row-level joins, orders, page totals, bands, long-form punch list."""

import datetime as dt

from helpers import depts_df, punches_df, users_df
from punchspark.operators import report_a as A
from punchspark.operators import report_b as B
from punchspark.operators import rollups as D


def frames(spark):
    users = users_df(spark, [(1, "E1", "Ann", "Lee", 1, "User", None, True), (2, "E2", "Bo", "Ng", 9, "User", None, False)])
    depts = depts_df(spark, [(1, "IT")])
    punches = punches_df(
        spark,
        [
            (1, "E1", "2026-01-05 09:00:00", "G", None, None),
            (2, "E1", "2026-01-05 19:30:00", "G", None, None),
            (3, "E2", "2026-01-06 09:00:00", "G", None, None),
            (4, "X9", "2026-01-06 10:00:00", "G", None, "Unauthorized Entry"),
            (5, "E1", "2026-01-06 08:55:00", "G", None, None),
        ],
    )
    return punches, users, depts


def test_row_level_joins(spark):
    punches, users, depts = frames(spark)
    inner = A.punch_roster_join(punches, users, depts)
    assert sorted(r["LogID"] for r in inner.collect()) == [1, 2, 5]  # E2 has no department, X9 no user
    active = A.active_punches(punches, users, depts).collect()
    assert {r["EmployeeNo"] for r in active} == {"E1"}
    assert sorted((r["LogDate"], r["LogTime"]) for r in active) == [
        (dt.date(2026, 1, 5), "09:00:00"),
        (dt.date(2026, 1, 5), "19:30:00"),
        (dt.date(2026, 1, 6), "08:55:00"),
    ]
    left = B.all_punches(punches, users, depts)
    assert left.count() == 5 and left.where("LogID = 4").first()["FirstName"] is None


def test_orders_pages_and_bands(spark):
    punches, users, depts = frames(spark)
    rec = A.daily_attendance(punches, users, depts)
    assert [(r["Date"], r["EmployeeID"]) for r in A.order_daily(rec).collect()] == [("2026-01-06", "E1"), ("2026-01-05", "E1")]
    tot = D.page_totals(rec, size=1).first()
    assert (tot["total"], tot["pages"]) == (2, 2)
    bands = {r["date"]: r["band"] for r in D.trend_bands(A.daily_trend(rec)).collect()}
    assert bands == {"2026-01-05": "info"}  # 10.5 h
    by_name = [r["EmployeeID"] for r in D.sort_records(rec, "Status", "desc").collect()]
    assert len(by_name) == 2


def test_long_form_punch_list(spark):
    punches, _, _ = frames(spark)
    got = sorted((r["EmployeeID"], r["rawDate"], r["Punch"]) for r in B.daily_punch_list(punches).collect())
    assert got[0] == ("E1", "2026-01-05", "7:30 PM") and got[1] == ("E1", "2026-01-05", "9:00 AM")
    assert len(got) == 5
