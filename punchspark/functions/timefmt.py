"""Time-of-day, hour and fixed-point formatting as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from punchspark.functions.text import JS_WS, col_of

MICROS_PER_HOUR = 3_600_000_000


def format_ampm(ts: Column | str) -> Column:
    """'9:15 AM' style (hour 0 shows as 12)."""
    return F.date_format(col_of(ts), "h:mm a")


def format_24h(ts: Column | str) -> Column:
    return F.date_format(col_of(ts), "HH:mm:ss")


def minute_of_day(ts: Column | str) -> Column:
    """hour * 60 + minute (seconds truncated)."""
    ts = col_of(ts)
    return (F.hour(ts) * 60 + F.minute(ts)).cast("bigint")


def weekday_name(d: Column | str) -> Column:
    """English weekday name."""
    return F.date_format(col_of(d), "EEEE")


def span_micros(first: Column | str, last: Column | str) -> Column:
    return F.timestamp_diff("MICROSECOND", col_of(first), col_of(last))


def hours_cents(first: Column | str, last: Column | str) -> Column:
    """Hours between two instants as integer hundredths, rounded half-up on microseconds."""
    us = span_micros(first, last)
    return F.floor((us * 100 + MICROS_PER_HOUR // 2) / F.lit(MICROS_PER_HOUR)).cast("bigint")


def cents_to_double(cents: Column) -> Column:
    return (cents / F.lit(100.0)).cast("double")


def cents_fixed2(cents: Column) -> Column:
    """Integer hundredths → 'I.DD' text (toFixed(2) on a non-negative value)."""
    return F.concat(
        (cents / 100).cast("bigint").cast("string"),
        F.lit("."),
        F.lpad(F.pmod(cents, F.lit(100)).cast("string"), 2, "0"),
    )


def cents_js_number(cents: Column) -> Column:
    """Integer hundredths → JS number text: 9 → '9', 9.5 → '9.5', 9.01 → '9.01'."""
    whole = (cents / 100).cast("bigint").cast("string")
    frac = F.pmod(cents, F.lit(100))
    return (
        F.when(frac == 0, whole)
        .when(F.pmod(frac, F.lit(10)) == 0, F.concat(whole, F.lit("."), (frac / 10).cast("bigint").cast("string")))
        .otherwise(F.concat(whole, F.lit("."), F.lpad(frac.cast("string"), 2, "0")))
    )


def half_up_ratio(num: Column, den: Column) -> Column:
    """round(num/den) half-up for non-negative integers, exact (no floating point)."""
    return F.floor((num * 2 + den) / (den * 2)).cast("bigint")


def time_to_minutes(text: Column | str) -> Column:
    """'H:M' → minutes; unparseable parts count as 0 (F2)."""
    parts = F.split(F.coalesce(col_of(text), F.lit("")), ":")
    h = F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit(""))
    m = F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))
    return (js_int_or_zero(h) * 60 + js_int_or_zero(m)).cast("bigint")


def minutes_to_time(mins: Column | str) -> Column:
    """Minutes → '9:05 AM' style text."""
    m = col_of(mins).cast("bigint")
    hrs = F.floor(m / 60)
    mm = F.pmod(m, F.lit(60))
    disp = F.when(F.pmod(hrs, F.lit(12)) == 0, F.lit(12)).otherwise(F.pmod(hrs, F.lit(12)))
    return F.format_string(
        "%d:%s %s", disp.cast("int"), F.lpad(mm.cast("string"), 2, "0"), F.when(hrs >= 12, "PM").otherwise("AM")
    )


def js_int_prefix(text: Column) -> Column:
    """parseInt(text, 10): leading integer, null when there is none (or it overflows bigint)."""
    digits = F.regexp_extract(text, rf"^{JS_WS}*([+-]?\d+)", 1)
    return F.when(digits != "", digits.try_cast("bigint"))


def js_int_or_zero(text: Column) -> Column:
    """parseInt(text) || 0."""
    return F.coalesce(js_int_prefix(text), F.lit(0).cast("bigint"))


def india_stamp(instant: Column | str) -> Column:
    """'yyyy-MM-dd HH:mm:ss' in Asia/Kolkata from a UTC instant."""
    return F.date_format(F.from_utc_timestamp(col_of(instant), "Asia/Kolkata"), "yyyy-MM-dd HH:mm:ss")
