"""Identity resolution of punch rows.

Order of the cascade for a row whose badge ID is a dummy or not on the roster:
  exact normalised name → word pairs (w1w2, w2w1, w1wN, wNw1) → loose containment
  of the raw first-name cell in an index key (first key by index position).

Scale notes: rows resolved by their ID never meet the name match. The others are
reduced by a partial aggregate to *distinct* (raw name, first-name cell) pairs, so a hot
name (every unread card of one person) is combined before any shuffle, and each pair
probes one lookup by equality: index keys, and the parts of index keys that may be sought, each
with the one employee it stands for. A probe meets one lookup row at most, so there are
no candidates to verify, no candidate cap and no cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punchspark import policy as P
from punchspark.functions.text import js_trim, name_key, normalize_name, upper_trim
from punchspark.operators.common import broadcast_if_small
from punchspark.sources.aliases import cells_for, resolve

METHODS = ("id", "exact", "words", "loose", "none")


def punch_cells(upload: DataFrame) -> DataFrame:
    """S5 for punch uploads: canonical raw cells from whatever headers the file has."""
    cells = cells_for(upload)
    ch = lambda aliases: resolve(cells, aliases)
    return upload.select(
        "upload_id",
        "row_ord",
        ch(P.PUNCH_ID_ALIASES).value.alias("id_cell"),
        F.coalesce(ch(P.PUNCH_FIRST_ALIASES).value, F.lit("")).alias("first_cell"),
        F.coalesce(ch(P.PUNCH_LAST_ALIASES).value, F.lit("")).alias("last_cell"),
        F.coalesce(ch(P.UNIFIED_NAME_ALIASES).value, F.lit("")).alias("unified_cell"),
        F.coalesce(ch(P.DEVICE_ALIASES).value, F.lit("")).alias("device_cell"),
        F.coalesce(ch(P.AREA_ALIASES).value, F.lit("")).alias("area_cell"),
        ch(P.DATE_ALIASES).value.alias("date_cell"),
        ch(P.TIME_ALIASES).value.alias("time_cell"),
    )


def roster_keys(users: DataFrame) -> DataFrame:
    """The ID set: upper-cased, trimmed EmployeeNo of every user."""
    return users.select(upper_trim(F.col("EmployeeNo")).alias("key")).distinct()


def name_index(users: DataFrame) -> DataFrame:
    """P5: (key, emp, pos). Keys: first+last and last+first when both, else the one present.

    Re-setting a key keeps its first position but takes the later user's value;
    load order is UserID order.
    """
    f = name_key(F.col("FirstName"))
    l = name_key(F.col("LastName"))  # noqa: E741
    both = (f != "") & (l != "")
    entries = F.when(
        both,
        F.array(
            F.struct(F.concat(f, l).alias("key"), F.lit(0).alias("slot")),
            F.struct(F.concat(l, f).alias("key"), F.lit(1).alias("slot")),
        ),
    ).when(f != "", F.array(F.struct(f.alias("key"), F.lit(0).alias("slot")))).when(
        l != "", F.array(F.struct(l.alias("key"), F.lit(0).alias("slot")))
    )
    exploded = users.select("UserID", "EmployeeNo", F.inline(entries))
    order = F.struct(F.col("UserID"), F.col("slot"))
    return exploded.groupBy("key").agg(
        F.max_by("EmployeeNo", order).alias("emp"), F.min(order).alias("pos")
    )


def _words_keys(norm: Column) -> Column:
    """w1w2, w2w1, w1wN, wNw1 when the cleaned name has at least two words."""
    w = F.filter(F.split(norm, " "), lambda x: F.length(x) > 0)
    first, second, last = (F.lower(F.element_at(w, i)) for i in (1, 2, -1))
    pairs = F.array(F.concat(first, second), F.concat(second, first), F.concat(first, last), F.concat(last, first))
    return F.when(F.size(w) >= 2, pairs).otherwise(F.array().cast("array<string>"))


#: Shortest first-name cell that the loose step looks for.
LOOSE_MIN_LENGTH = 3


def sought_parts(index: DataFrame, names: DataFrame) -> DataFrame:
    """P8's lookup: (key, emp) of the parts of index keys that may be sought, each with the first key that holds it.

    A key has one row for each of its suffixes, that is, as many as it has letters. A part is the
    beginning of a suffix, so a suffix meets the lengths of those texts only that begin with its own
    first letters; a suffix whose beginning nobody seeks ends there.
    """
    start = lambda c: F.substring(c, 1, LOOSE_MIN_LENGTH)
    needle = _needle()
    # The count keeps the distinct names below as they are, so their exchange is reused.
    sought = names.groupBy(start(needle).alias("start")).agg(F.collect_set(F.length(needle)).alias("lengths"), F.count(F.lit(1)).alias("n"))
    firsts = F.sequence(F.lit(1), F.length("key") - (LOOSE_MIN_LENGTH - 1))
    long_enough = index.where(F.length("key") >= LOOSE_MIN_LENGTH)
    suffixes = long_enough.select("emp", "pos", F.explode(F.transform(firsts, lambda i: F.substr(F.col("key"), i))).alias("suffix"))
    met = suffixes.withColumn("start", start(F.col("suffix"))).join(sought.where("start is not null").select("start", "lengths"), "start")
    fits = F.filter("lengths", lambda n: n <= F.length("suffix"))
    parts = met.select("emp", "pos", F.explode(F.transform(fits, lambda n: F.substring(F.col("suffix"), 1, n))).alias("key"))
    return parts.groupBy("key").agg(F.min_by("emp", "pos").alias("emp"))


def _needle() -> Column:
    """P8's text: the lower-cased first-name cell when it is long enough, else null."""
    cell = F.lower(js_trim(F.col("first_cell")))
    return F.when((F.col("first_cell") != "") & (F.length(cell) >= LOOSE_MIN_LENGTH), cell)


def match_names(names: DataFrame, index: DataFrame, loose: bool = True) -> DataFrame:
    """P6-P8 on distinct names (raw_name, first_cell, norm) → raw_name, first_cell, matched, method.

    Each name explodes into at most six probes (priority, kind, key); the lookups hold one row
    per (kind, key), so the join is 1:1 and the best hit is a minimum per name.
    """
    whole = F.regexp_replace(F.lower(F.col("norm")), r"\s+", "")
    keys = F.when(F.col("norm") != "", F.concat(F.array(whole), _words_keys(F.col("norm")))).otherwise(F.array().cast("array<string>"))
    probes = F.transform(keys, lambda k, i: F.struct(i.alias("prio"), F.lit("key").alias("kind"), k.alias("key")))
    lookup = index.select(F.lit("key").alias("kind"), "key", "emp").where(F.col("emp") != "")
    if loose:
        last = F.struct(F.lit(len(METHODS)).alias("prio"), F.lit("part").alias("kind"), _needle().alias("key"))
        probes = F.concat(probes, F.array(last))
        parts = sought_parts(index, names)
        lookup = lookup.unionAll(parts.select(F.lit("part").alias("kind"), "key", "emp"))
    probed = names.select("raw_name", "first_cell", F.inline_outer(probes))
    hit = F.when(F.col("emp").isNotNull(), F.struct("prio", "emp"))
    best = probed.join(lookup, ["kind", "key"], "left").groupBy("raw_name", "first_cell").agg(F.min(hit).alias("hit"))
    prio = F.col("hit.prio")
    method = F.when(prio == 0, "exact").when(prio < len(METHODS), "words").when(prio.isNotNull(), "loose")
    return best.select("raw_name", "first_cell", F.col("hit.emp").alias("matched"), method.alias("method"))


def resolve_identity(cells: DataFrame, users: DataFrame, loose: bool = True) -> DataFrame:
    """Adds EmployeeNo, unauthorized flag and match_method to punch cells.

    Rows with an ID on the roster are done with the roster lookup and are not shuffled by
    name. The others join the match results (one row per distinct name) by name; a hot name
    is split by the adaptive skew join, and small results are broadcast at run time.
    """
    keys = broadcast_if_small(roster_keys(users))  # the roster: checked once, reused
    raw_id = upper_trim(F.coalesce(F.col("id_cell"), F.lit("")))
    full = js_trim(F.concat(F.col("first_cell"), F.lit(" "), F.col("last_cell")))
    raw_name = F.when(full != "", full).otherwise(js_trim(F.col("unified_cell")))
    rows = cells.select("*", raw_id.alias("raw_id"))
    rows = rows.join(keys.select(F.col("key").alias("raw_id"), F.lit(True).alias("known")), "raw_id", "left")
    # A non-dummy ID on the roster is kept as is
    by_id = ~F.col("raw_id").isin(*P.DUMMY_IDS) & F.coalesce(F.col("known"), F.lit(False))
    done = rows.where(by_id).select(
        *cells.columns, F.col("raw_id").alias("EmployeeNo"), F.lit(False).alias("unauthorized"), F.lit("id").alias("match_method")
    )

    rest = rows.where(~by_id).withColumn("raw_name", raw_name)
    names = rest.select("raw_name", "first_cell").distinct().withColumn("norm", normalize_name(F.col("raw_name")))
    matched = match_names(names, name_index(users), loose)
    matched = matched.join(keys.select(F.col("key").alias("matched"), F.lit(True).alias("matched_known")), "matched", "left")
    rest = rest.join(matched, ["raw_name", "first_cell"], "left")
    ok_name = F.coalesce(F.col("matched_known"), F.lit(False))
    emp = (
        F.when(ok_name, F.col("matched"))
        .when(F.col("raw_id") == "", F.lit(P.NOT_PROVIDED))
        .otherwise(F.col("raw_id"))
    )
    rest = rest.select(
        *cells.columns,
        emp.alias("EmployeeNo"),
        (~ok_name).alias("unauthorized"),
        F.when(ok_name, F.col("method")).otherwise(F.lit("none")).alias("match_method"),
    )
    return done.unionAll(rest)
