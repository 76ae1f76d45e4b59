import datetime as dt

import pytest
from pyspark.sql import functions as F

from punchspark.functions.dtparse import with_punch_datetime
from punchspark.functions.text import js_trim, normalize_name
from punchspark.functions.timefmt import cents_fixed2, cents_js_number, format_ampm, hours_cents, minutes_to_time, time_to_minutes


def parse(spark, rows, strict=False):
    df = spark.createDataFrame(rows, "i int, d string, t string")
    out = with_punch_datetime(df, "d", "t", "ts", strict).orderBy("i").collect()
    return [r["ts"] for r in out]


def test_date_texts_from_fixtures(spark):
    got = parse(
        spark,
        [
            (1, "2026-05-25", "09:15:00"),
            (2, "25-05-2026", None),
            (3, "05/25/2026", "18:05"),
            (4, "25/12/2025", None),
            (5, "45992", None),
            (6, "", None),
            (7, "abc", None),
            (8, "25 May 2026", "7:05"),
        ],
    )
    assert got == [
        dt.datetime(2026, 5, 25, 9, 15),
        dt.datetime(2026, 5, 25),
        dt.datetime(2026, 5, 25, 18, 5),
        dt.datetime(2027, 1, 12),  # month 25 rolls over
        dt.datetime(2025, 12, 1),
        None,
        None,
        dt.datetime(2026, 5, 25, 7, 5),
    ]


def test_excel_serial_times_drop_seconds(spark):
    got = parse(spark, [(1, "45992", "0.385417"), (2, "45992", "0.753472"), (3, "45992.5", None), (4, "45992", "10:30:15")])
    assert got == [
        dt.datetime(2025, 12, 1, 9, 15),
        dt.datetime(2025, 12, 1, 18, 5),
        dt.datetime(2025, 12, 1, 12, 0),
        dt.datetime(2025, 12, 1, 10, 30, 15),
    ]


def test_pm_is_lost_and_two_digit_year(spark):
    got = parse(spark, [(1, "05/25/2026", "9:15 PM"), (2, "1-1-05", None)])
    assert got == [dt.datetime(2026, 5, 25, 9, 15), dt.datetime(1905, 1, 1)]


def test_strict_serial_rejects_out_of_range(spark):
    got = parse(spark, [(1, "20260525", None), (2, "0.5", None), (3, "45992", None)], strict=True)
    assert got == [None, None, dt.datetime(2025, 12, 1)]


@pytest.mark.parametrize(
    "raw,expected",
    [
        ("NULL John (Contractor) 123 Smith", "John Smith"),
        ("  A. B. Word-Word ", "Word Word"),
        ("Jane  Doe NULL", "Jane Doe"),
        ("", ""),
        ("o'neil, mary", "o'neil mary"),
    ],
)
def test_normalize_name(spark, raw, expected):
    got = spark.createDataFrame([(raw,)], "n string").select(normalize_name("n").alias("x")).first()["x"]
    assert got == expected


def test_js_trim_all_whitespace(spark):
    got = spark.createDataFrame([("\t a b \n",)], "s string").select(js_trim("s").alias("x")).first()["x"]
    assert got == "a b"


@pytest.mark.parametrize(
    "first,last,cents,fixed,js",
    [
        ("09:00:00", "18:00:00", 900, "9.00", "9"),
        ("09:00:00", "18:00:01", 900, "9.00", "9"),
        ("09:00:00", "18:00:18", 901, "9.01", "9.01"),  # half-cent tie → up
        ("09:00:00", "18:30:00", 950, "9.50", "9.5"),
    ],
)
def test_hours_half_up(spark, first, last, cents, fixed, js):
    df = spark.createDataFrame([(dt.datetime.fromisoformat(f"2026-01-05 {first}"), dt.datetime.fromisoformat(f"2026-01-05 {last}"))], "a timestamp_ntz, b timestamp_ntz")
    r = df.select(hours_cents("a", "b").alias("c")).select("c", cents_fixed2(F.col("c")).alias("f"), cents_js_number(F.col("c")).alias("j")).first()
    assert (r["c"], r["f"], r["j"]) == (cents, fixed, js)


def test_clock_helpers(spark):
    df = spark.createDataFrame([("9:15", 555, dt.datetime(2026, 1, 5, 0, 5))], "t string, m int, ts timestamp_ntz")
    r = df.select(time_to_minutes("t").alias("a"), minutes_to_time("m").alias("b"), format_ampm("ts").alias("c")).first()
    assert (r["a"], r["b"], r["c"]) == (555, "9:15 AM", "12:05 AM")


def test_merge_typed_date_and_india_stamp(spark):
    from punchspark.functions.dtparse import merge_date_time
    from punchspark.functions.timefmt import india_stamp

    df = spark.createDataFrame(
        [(dt.date(2026, 5, 25), "9:15:07"), (dt.date(2026, 5, 25), None), (dt.date(2026, 5, 25), "25:00")],
        "d date, t string",
    )
    got = [r["x"] for r in df.select(merge_date_time("d", "t").alias("x")).collect()]
    assert got == [dt.datetime(2026, 5, 25, 9, 15, 7), dt.datetime(2026, 5, 25), dt.datetime(2026, 5, 26, 1, 0)]
    inst = spark.createDataFrame([(dt.datetime(2026, 1, 5, 18, 45),)], "u timestamp_ntz").select(F.col("u").cast("timestamp").alias("u"))
    assert inst.select(india_stamp("u").alias("s")).first()["s"] == "2026-01-06 00:15:00"
