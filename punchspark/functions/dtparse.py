"""Punch date/time parsing as pure column expressions.

Everything is computed as epoch microseconds (bigint) and turned into a
TIMESTAMP_NTZ once, so no session time zone is involved.

Rules (reference semantics):
* Date cell that is a plain decimal number (no '-' or '/') is an Excel serial:
  day 25569 is 1970-01-01, the fraction is the time of day.
  - numeric time cell: day fraction, rounded to whole seconds, then seconds dropped;
  - text time cell 'H:M[:S]': set on the serial's day;
  - no time cell: the serial's own fraction is kept (millisecond precision).
* Text date with '-': 4-digit first part → Y-M-D, otherwise D-M-Y.
  Text date with '/': always M/D/Y.
  Time 'H:M[:S]' (parseInt per part, unparseable → 0); missing → 00:00:00.
  Out-of-range parts roll over (25/12/2025 → 2027-01-12); years 0-99 mean 1900+.
* Other text: one of FREE_TEXT_DATE_FORMATS plus a clock time H:M[:S], AM or PM allowed;
  a time that is no clock time makes the row unparseable.
* Anything else (empty, unparseable) → null, and the row is dropped by the caller.

Documented deviations: results outside years 1..9999 are null; a free-text date uses
the fixed format list below instead of a general date parser.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punchspark.functions.text import JS_WS, col_of, js_trim
from punchspark.functions.timefmt import js_int_or_zero
from punchspark.policy import EXCEL_EPOCH_SERIAL, EXCEL_MAX_SERIAL

# Accepted free-text date formats (tried in this order).
FREE_TEXT_DATE_FORMATS = (
    "d MMM yyyy",
    "d MMMM yyyy",
    "MMM d yyyy",
    "MMMM d yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "yyyy.MM.dd",
    "MM.dd.yyyy",
)

US_PER_SEC = 1_000_000
US_PER_DAY = 86_400 * US_PER_SEC
# Epoch-second bounds of 0001-01-01 and 9999-12-31 23:59:59.
_MIN_EPOCH_SEC = -62_135_596_800
_MAX_EPOCH_SEC = 253_402_300_799


def epoch_ntz() -> Column:
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")


def micros_to_ntz(us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us, epoch_ntz())


def _in_range_secs(secs: Column) -> Column:
    return (secs >= F.lit(_MIN_EPOCH_SEC)) & (secs <= F.lit(_MAX_EPOCH_SEC))


def _part(parts: Column, i: int) -> Column:
    return F.try_element_at(parts, F.lit(i))


def _time_secs(time_text: Column) -> Column:
    """'H:M:S' → seconds via parseInt(part) || 0 (hours may exceed 23: JS rolls over)."""
    parts = F.split(time_text, ":")
    h = js_int_or_zero(F.coalesce(_part(parts, 1), F.lit("")))
    m = js_int_or_zero(F.coalesce(_part(parts, 2), F.lit("")))
    s = js_int_or_zero(F.coalesce(_part(parts, 3), F.lit("")))
    ok = (F.abs(h) < 10**9) & (F.abs(m) < 10**10) & (F.abs(s) < 10**12)
    return F.when(ok, h * 3600 + m * 60 + s)


def _clock_secs(parts: Column) -> Column:
    """H:M:S from parsed parts with parseInt(part) || 0 (hours may exceed 23: JS rolls over)."""
    h, m, sec = (F.coalesce(_int_at(parts, i), F.lit(0).cast("bigint")) for i in (1, 2, 3))
    ok = (F.abs(h) < 10**9) & (F.abs(m) < 10**10) & (F.abs(sec) < 10**12)
    return F.when(ok, h * 3600 + m * 60 + sec)


def _free_clock(text: Column, clock: Column, parts: Column) -> Column:
    """Seconds of a clock time beside a free-text date: 24 hours, or 12 with AM or PM; no time is midnight."""
    h, m, s = (F.coalesce(_int_at(parts, i), F.lit(0).cast("bigint")) for i in (1, 2, 3))
    half = clock.endswith("M")
    hours = F.when(half, h % 12 + F.when(clock.endswith("PM"), 12).otherwise(0)).otherwise(h)
    ok = (clock != "") & (m < 60) & (s < 60) & F.when(half, (h >= 1) & (h <= 12)).otherwise(h < 24)
    return F.when(text == "", F.lit(0).cast("bigint")).when(ok, hours * 3600 + m * 60 + s)


def _plain_number(x: Column, allow_minus: bool) -> Column:
    """JS Number(x) is a finite number, for plain decimal/exponent text (no regex)."""
    allowed = "0123456789.+e" + ("-" if allow_minus else "")
    return (x != "") & (F.length(F.translate(F.lower(x), allowed, "")) == 0) & x.try_cast("double").isNotNull()


def _int_parts(text: Column, sep: str, signs: str) -> Column:
    """parseInt of every ``sep``-separated part in one regex pass: '' where a part has no number."""
    return F.regexp_extract_all(text, F.lit(rf"(?:^|{sep}){JS_WS}*([{signs}]?\d*)[^{sep[-1]}]*"), 1)


def _int_at(parts: Column, i: int) -> Column:
    return F.try_element_at(parts, F.lit(i)).try_cast("bigint")


def codegen_barrier(df: DataFrame, label: str) -> DataFrame:
    """A metrics node (row count): it is not code-generated, so it splits whole-stage
    code and stops predicate pushdown, without a shuffle. Keeps generated methods
    under the JIT's size limit when a long chain of expressions would be fused."""
    return df.observe(f"{label}_{uuid.uuid4().hex[:12]}", F.count(F.lit(1)).alias("rows"))


def _stages(df: DataFrame, stages: list[dict[str, Column] | None]) -> DataFrame:
    for st in stages:
        df = codegen_barrier(df, "punch_parse_split") if st is None else df.withColumns(st)
    return df


def with_punch_datetime(
    df: DataFrame, date_cell: str, time_cell: str | None, out: str = "PunchDateTime", strict_serial: bool = False
) -> DataFrame:
    """Add ``out`` (TIMESTAMP_NTZ, null when unparseable) from text date/time cells.

    Every intermediate value is its own column, computed once and referenced by
    name, so the generated code stays small and inside whole-stage codegen.
    """
    p = "__dt_"

    def c(name: str) -> Column:
        return F.col(p + name)

    t_src = F.col(time_cell) if time_cell else F.lit(None).cast("string")
    d = F.col(date_cell)
    lo, hi = (1, EXCEL_MAX_SERIAL) if strict_serial else (-693593, EXCEL_MAX_SERIAL)
    stages = [
        None,  # keep the parser's generated code apart from whatever produced the cells
        # raw cells
        {
            p + "d": js_trim(F.coalesce(d, F.lit(""))),
            p + "present": d.isNotNull() & (d != ""),
            p + "t": F.coalesce(t_src, F.lit("")),
            p + "tt": js_trim(F.coalesce(t_src, F.lit(""))),
        },
        {
            p + "kind": F.when(~c("present"), F.lit(0))
            .when(_plain_number(c("d"), allow_minus=False), F.lit(1))
            .when(c("d").contains("-"), F.lit(2))
            .when(c("d").contains("/"), F.lit(3))
            .otherwise(F.lit(4)),
            # parseInt of each part: '-' parts carry no sign, '/' parts may start with '+'
            p + "dparts": F.when(c("d").contains("-"), _int_parts(c("d"), "-", "+")).otherwise(_int_parts(c("d"), "/", "+")),
            p + "first_len": F.length(F.substring_index(c("d"), "-", 1)),
            p + "tparts": _int_parts(F.when(c("tt").startswith(":"), F.concat(F.lit("0"), c("tt"))).otherwise(c("tt")), ":", "+-"),
            p + "clock": F.regexp_extract(F.upper(c("tt")), r"^\d{1,2}:\d{1,2}(?::\d{1,2})?\s*(AM|PM)?$", 0),
            p + "t_num": F.when(_plain_number(c("tt"), allow_minus=True), c("tt").try_cast("double")),
        },
        {
            p + "a": _int_at(c("dparts"), 1),
            p + "b": _int_at(c("dparts"), 2),
            p + "c": _int_at(c("dparts"), 3),
            p + "ymd": c("first_len") == 4,
            p + "tsecs": _clock_secs(c("tparts")),  # '' parses as 0 = '00:00:00'
            p + "raw": F.when(c("kind") == 1, c("d").try_cast("double")),
            p + "free": F.when(c("kind") == 4, F.coalesce(*[F.try_to_date(c("d"), fmt) for fmt in FREE_TEXT_DATE_FORMATS])),
            # Math.round(t*24*60*60)
            p + "tot": F.when(F.abs(c("t_num")) < 1e6, F.floor(c("t_num") * 24 * 60 * 60 + 0.5).cast("bigint")),
        },
        None,  # split the generated code here
        {
            # text dates: D-M-Y, Y-M-D or M/D/Y; years 0-99 mean 1900+
            p + "y0": F.when(c("kind") == 3, c("c")).when(c("ymd"), c("a")).otherwise(c("c")),
            p + "m0": F.when(c("kind") == 3, c("a")).otherwise(c("b")) - 1,
            p + "dd": F.when(c("kind") == 3, c("b")).when(c("ymd"), c("c")).otherwise(c("a")),
            # serial: new Date((raw - 25569) * 86400 * 1000), ms truncated toward zero
            p + "base_us": F.when(
                c("raw").isNotNull() & (c("raw") >= lo) & (c("raw") < hi + 1),
                ((c("raw") - F.lit(EXCEL_EPOCH_SERIAL)) * 86400 * 1000).cast("bigint") * 1000,
            ),
            # numeric time → whole hours and minutes (seconds dropped; JS % keeps the sign)
            p + "hm_secs": F.floor(c("tot") / 3600).cast("bigint") * 3600
            + F.floor((c("tot") - (c("tot") / 3600).cast("bigint") * 3600) / 60).cast("bigint") * 60,
            p + "free_secs": F.unix_date(c("free")).cast("bigint") * 86400 + _free_clock(c("tt"), c("clock"), c("tparts")),
        },
        {
            p + "months": F.when(
                c("y0").isNotNull() & c("m0").isNotNull() & c("dd").isNotNull() & c("tsecs").isNotNull()
                & (F.abs(c("y0")) < 10**6) & (F.abs(c("m0")) < 10**7) & (F.abs(c("dd")) < 10**8),
                F.when((c("y0") >= 0) & (c("y0") <= 99), c("y0") + 1900).otherwise(c("y0")) * 12 + c("m0"),
            ),
            p + "day0_us": F.floor(c("base_us") / F.lit(US_PER_DAY)).cast("bigint") * US_PER_DAY,
        },
        {
            p + "ym": F.floor(c("months") / 12).cast("bigint"),
            p + "mn": F.pmod(c("months"), F.lit(12)),
        },
        {
            p + "text_secs": F.when(
                (c("ym") >= 1) & (c("ym") <= 9999),
                (F.unix_date(F.make_date(c("ym").cast("int"), (c("mn") + 1).cast("int"), F.lit(1))).cast("bigint") + c("dd") - 1)
                * 86400
                + c("tsecs"),
            ),
        },
        {
            p + "us": F.when(
                c("kind") == 1,
                F.when(c("base_us").isNull(), F.lit(None).cast("bigint"))
                .when(c("tot").isNotNull(), c("day0_us") + c("hm_secs") * US_PER_SEC)
                .when(c("t") != "", c("day0_us") + c("tsecs") * US_PER_SEC)
                .otherwise(c("base_us")),
            )
            .when(
                (c("kind") == 2) | (c("kind") == 3),
                F.when(_in_range_secs(c("text_secs")), c("text_secs") * US_PER_SEC),
            )
            .when(
                c("kind") == 4,
                F.when(c("free").isNotNull() & _in_range_secs(c("free_secs")), c("free_secs") * US_PER_SEC),
            )
        },
    ]
    staged = _stages(df, stages)
    # Barrier: without it a later filter on ``out`` is pushed down through every stage
    # and the stages are inlined into one exponentially large expression. A metrics
    # node stops predicate pushdown without a shuffle (and counts parsed rows).
    staged = staged.observe(
        f"punch_parse_{uuid.uuid4().hex[:12]}",
        F.count(F.lit(1)).alias("rows"),
        F.count(c("us")).alias("parsed"),
    )
    helpers = [x for x in staged.columns if x.startswith(p)]
    return staged.withColumn(out, micros_to_ntz(c("us"))).drop(*helpers)


def merge_date_time(date_col: Column | str, time_cell: Column | str | None) -> Column:
    """Typed date/timestamp cell plus optional 'H:M:S' text → TIMESTAMP_NTZ."""
    base = col_of(date_col).cast("timestamp_ntz")
    if time_cell is None:
        return base
    t = col_of(time_cell)
    day_us = F.unix_date(base.cast("date")).cast("bigint") * US_PER_DAY
    secs = _time_secs(js_trim(t))
    return F.when(F.coalesce(t, F.lit("")) != "", micros_to_ntz(day_us + secs * US_PER_SEC)).otherwise(base)
