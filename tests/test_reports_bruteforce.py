"""Reports A and B against a plain-Python brute force of their rules on random punches."""

import datetime as dt
import random

from helpers import depts_df, punches_df, users_df
from punchspark.operators import report_a as A
from punchspark.operators import report_b as B

WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def cents_of(first, last):
    us = (last - first) // dt.timedelta(microseconds=1)
    return (us * 100 + 1_800_000_000) // 3_600_000_000, us


def ampm(t):
    return f"{t.hour % 12 or 12}:{t.minute:02d} {'PM' if t.hour >= 12 else 'AM'}"


def js_num(c):
    w, f = divmod(c, 100)
    return str(w) if f == 0 else (f"{w}.{f // 10}" if f % 10 == 0 else f"{w}.{f:02d}")


def mins(t):
    return t.hour * 60 + t.minute


def brute_a(users, depts, punches):
    u = {r[1]: r for r in users}
    d = dict(depts)
    groups = {}
    for _, emp, ts, *_ in punches:
        if emp in u and u[emp][4] in d:
            groups.setdefault((emp, ts.date()), []).append(ts)
    out = {}
    for (emp, day), tss in groups.items():
        f, l = min(tss), max(tss)  # noqa: E741
        single = f == l
        cents, us = cents_of(f, l)
        late, early = mins(f) > 550, mins(l) < 1080
        if single:
            st = "Incomplete Record"
        elif early:
            st = "LATE_ENTRY_AND_EARLY_EXIT" if late else "EARLY_DEPARTURE"
        elif late:
            st = "LATE_ENTRY_AND_LATE_EXIT"
        else:
            st = "OVERTIME" if us > 9 * 3_600_000_000 else "ONTIME"
        user = u[emp]
        out[(emp, day.isoformat())] = (
            f"{user[2] or ''} {user[3] or ''}",
            d[user[4]],
            user[6] or "Regular",
            WEEKDAYS[day.weekday()],
            f.strftime("%H:%M:%S"),
            "Missing Checkout" if single else l.strftime("%H:%M:%S"),
            "-" if single else f"{cents // 100}.{cents % 100:02d}",
            st,
        )
    return out


def clean(x):
    x = (x or "").strip()
    return "" if x.upper() == "NULL" else x


def brute_b(users, depts, punches):
    u = {r[1]: r for r in users}
    d = dict(depts)
    groups = {}
    for log, emp, ts, _, _, status in punches:
        key = "UNKNOWN" if not emp else emp.strip()
        groups.setdefault((key, ts.date()), []).append((ts, log, emp, status))
    out = {}
    for (key, day), rows in groups.items():
        rows.sort()
        f, l = rows[0][0], rows[-1][0]  # noqa: E741
        head_emp, head_status = rows[0][2], rows[0][3]
        user = u.get(head_emp)
        fn, ln = (clean(user[2]), clean(user[3])) if user else ("", "")
        unauth = head_status == "Unauthorized Entry"
        name = f"{fn} {ln}".strip() or ("Unauthorized Entry" if unauth else "Unknown Employee")
        dept = d.get(user[4]) if user else None
        dept = dept.strip() if dept else "Unassigned"
        etype = user[6].strip() if user and user[6] else "N/A"
        if f == l:
            morning = f.hour < 13
            fi, lo = (ampm(f), None) if morning else (None, ampm(f))
            total = "Not Checked Out" if morning else "Not Checked In"
            st = "Early Departure" if morning else "Late Arrival"
        else:
            cents = max(cents_of(f, l)[0], 0)
            fi, lo, total = ampm(f), ampm(l), js_num(cents)
            late, early = mins(f) > 540, mins(l) < 1080
            st = "Overtime" if cents > 900 else "Late & Early" if late and early else "Late Arrival" if late else "Early Departure" if early else "Compliant"
        if unauth:
            st = "Unauthorized Entry"
        out[(key, day.isoformat())] = (fn, ln, name, dept, etype, day.strftime("%d-%m-%Y"), WEEKDAYS[day.weekday()], fi, lo, total, st)
    return out


def test_reports_match_brute_force(spark, tmp_path):
    rnd = random.Random(21)
    users = [
        (i + 1, f"E{i}", rnd.choice(["Ann", "", None, "NULL", " Bo "]), rnd.choice(["Lee", "NULL", None, "Ng"]), rnd.choice([1, 2, 9]), "User", rnd.choice([None, "", "Perm"]), True)
        for i in range(12)
    ]
    depts = [(1, "IT"), (2, " Ops ")]
    punches, log = [], 1
    for _ in range(300):
        emp = rnd.choice([f"E{rnd.randrange(12)}"] * 8 + ["X1", "", None, " E3 "])
        day = dt.date(2026, 1, 5) + dt.timedelta(days=rnd.randrange(4))
        base = dt.datetime.combine(day, dt.time(rnd.choice([7, 8, 9, 12, 13, 17, 18, 19]), rnd.randrange(60), rnd.randrange(60)))
        ts = rnd.choice([base, base, base.replace(hour=9, minute=0, second=0), base.replace(hour=18, minute=0, second=0), base.replace(hour=18, minute=0, second=18)])
        status = "Unauthorized Entry" if emp in ("X1", "", None) and rnd.random() < 0.7 else None
        punches.append((log, emp, ts, "G", None, status))
        log += 1
    p = punches_df(spark, [(a, b, c.isoformat(sep=" "), d, e, f) for a, b, c, d, e, f in punches])
    udf, ddf = users_df(spark, users), depts_df(spark, depts)

    got_a = {
        (r["EmployeeID"], r["Date"]): (r["Name"], r["Department"], r["EmpType"], r["Weekday"], r["FirstIn"], r["LastOut"], r["TotalHours"], r["Status"])
        for r in A.daily_attendance(p, udf, ddf).collect()
    }
    assert got_a == brute_a(users, depts, punches)

    expected_b = brute_b(users, depts, punches)
    udf.write.parquet(str(tmp_path / "users"))
    for users_frame in (udf, spark.read.parquet(str(tmp_path / "users"))):  # without and with a size estimate
        got_b = {
            (r["EmployeeID"], r["rawDate"]): (r["FirstName"], r["LastName"], r["Name"], r["Department"], r["EmpType"], r["Date"], r["Weekday"], r["FirstIn"], r["LastOut"], r["TotalHours"], r["Status"])
            for r in B.daily_report_b(p, users_frame, ddf).collect()
        }
        assert got_b == expected_b
