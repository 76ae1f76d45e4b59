"""Date/time parsing against a plain-Python brute force of the same rules on random texts."""

import datetime as dt
import math
import random
import re

from pyspark.sql import functions as F

from punchspark.functions.dtparse import with_punch_datetime

EPOCH = dt.datetime(1970, 1, 1)


def parse_int(s):
    m = re.match(r"^\s*([+-]?\d+)", s or "")
    return int(m.group(1)) if m else None


def js_date(y, m0, d, secs):
    if None in (y, m0, d):
        return None
    if 0 <= y <= 99:
        y += 1900
    months = y * 12 + m0
    ym, mn = divmod(months, 12)
    if not 1 <= ym <= 9999:
        return None
    try:
        out = dt.datetime(ym, mn + 1, 1) + dt.timedelta(days=d - 1, seconds=secs)
    except OverflowError:
        return None
    return out


def clock(t):
    parts = t.split(":")
    vals = [(parse_int(parts[i]) if i < len(parts) else None) or 0 for i in range(3)]
    return vals[0] * 3600 + vals[1] * 60 + vals[2]


def plain_number(s, minus):
    allowed = set("0123456789.+e" + ("-" if minus else ""))
    if s == "" or any(c not in allowed for c in s.lower()):
        return None
    try:
        return float(s)
    except ValueError:
        return None


def brute(d, t):
    if not d:
        return None
    ds, tt = d.strip(), (t or "").strip()
    num = plain_number(ds, minus=False)
    if num is not None:
        if not (-693593 <= num < 2958466):
            return None
        ms = int((num - 25569) * 86400 * 1000)
        base = EPOCH + dt.timedelta(milliseconds=ms)
        day = EPOCH + dt.timedelta(days=math.floor(ms / 86400000))
        tn = plain_number(tt, minus=True)
        if tn is not None:
            tot = math.floor(tn * 24 * 60 * 60 + 0.5)
            h = math.floor(tot / 3600)
            rem = tot - int(tot / 3600) * 3600
            return day + dt.timedelta(seconds=h * 3600 + math.floor(rem / 60) * 60)
        if t:
            return day + dt.timedelta(seconds=clock(tt))
        return base
    secs = clock(tt) if t else 0
    if "-" in ds:
        p = ds.split("-")
        g = lambda i: parse_int(p[i]) if i < len(p) else None
        if len(p[0]) == 4:
            return js_date(g(0), None if g(1) is None else g(1) - 1, g(2), secs)
        return js_date(g(2), None if g(1) is None else g(1) - 1, g(0), secs)
    if "/" in ds:
        p = ds.split("/")
        g = lambda i: parse_int(p[i]) if i < len(p) else None
        return js_date(g(2), None if g(0) is None else g(0) - 1, g(1), secs)
    return "free"  # free-text formats are checked by example elsewhere


def rand_text(rnd):
    k = rnd.random()
    if k < 0.25:
        return f"{rnd.randint(1, 40):02d}-{rnd.randint(0, 14):02d}-{rnd.choice([2024, 2025, 26, 5, 1999])}", rnd.choice(["", None, "9:15", "25:61:70", "07:05 PM", "x:10", " 8:00:09 "])
    if k < 0.5:
        return f"{rnd.choice([2024, 2026, 1900])}-{rnd.randint(0, 13)}-{rnd.randint(0, 33)}{rnd.choice(['', ' 10:00', 'T1'])}", rnd.choice(["", "23:59:59", "12", "-1:30"])
    if k < 0.75:
        return f"{rnd.randint(0, 13)}/{rnd.randint(0, 40)}/{rnd.choice([2025, 99, 2030])}", rnd.choice([None, "6:7:8", "0.5", ""])
    serial = rnd.choice([str(rnd.randint(30000, 60000)), f"{rnd.uniform(40000, 50000):.5f}", "0", "3000000"])
    return serial, rnd.choice([None, "", f"{rnd.random():.6f}", "10:30:15", "1.25"])


def test_parser_matches_brute_force(spark):
    rnd = random.Random(5)
    rows = [(i, *rand_text(rnd)) for i in range(600)]
    df = spark.createDataFrame(rows, "i int, d string, t string")
    got = {r["i"]: r["ts"] for r in with_punch_datetime(df, "d", "t", "ts").select("i", "ts").collect()}
    checked = 0
    for i, d, t in rows:
        exp = brute(d, t)
        if exp == "free":
            continue
        checked += 1
        assert got[i] == exp, (d, t, got[i], exp)
    assert checked > 500
    assert df.where(F.col("d").isNull()).count() == 0
