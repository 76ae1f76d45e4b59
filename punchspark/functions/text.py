"""String rules as column expressions (JS trim, falsy fall-through, "NULL" text, name cleaning)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace class of JavaScript's \s and trim() (ASCII whitespace, no-break
# space, BOM and the Unicode space separators), written for Java regex.
JS_WS = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
_WS_EDGES = rf"^{JS_WS}+|{JS_WS}+$"


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_trim(c: Column | str) -> Column:
    """Trim every whitespace kind at both ends (Spark's trim only strips spaces)."""
    return F.regexp_replace(col_of(c), _WS_EDGES, "")


def falsy_to_null(c: Column | str) -> Column:
    """JS `a || b` falls through on '' and null; this maps '' to null so coalesce() can do the rest."""
    c = col_of(c)
    return F.when(c != F.lit(""), c)


def null_text_to_empty(c: Column | str) -> Column:
    """Trimmed value, '' when missing or equal to the text NULL (any case)."""
    t = js_trim(F.coalesce(col_of(c), F.lit("")))
    return F.when(F.upper(t) == F.lit("NULL"), F.lit("")).otherwise(t)


def upper_trim(c: Column | str) -> Column:
    return F.upper(js_trim(col_of(c)))


def normalize_name(c: Column | str) -> Column:
    """Clean a badge-reader name: drop leading 'NULL ' / trailing ' NULL', (...) parts,
    digits, punctuation; collapse spaces; drop one-letter words."""
    x = js_trim(F.coalesce(col_of(c), F.lit("")))
    x = F.regexp_replace(x, rf"(?i)^null{JS_WS}+", "")
    x = F.regexp_replace(x, rf"(?i){JS_WS}+null$", "")
    x = F.regexp_replace(x, r"\(.*?\)", "")
    x = F.regexp_replace(x, r"\d+", "")
    x = F.regexp_replace(x, r"[.,/#!$%^&*;:{}=\-_`~?]", " ")
    x = js_trim(F.regexp_replace(x, rf"{JS_WS}+", " "))
    return F.array_join(F.filter(F.split(x, " "), lambda w: F.length(w) > 1), " ")


def name_key(c: Column | str) -> Column:
    """Lower-case, all whitespace removed (the name index key form)."""
    return F.regexp_replace(F.lower(js_trim(F.coalesce(col_of(c), F.lit("")))), rf"{JS_WS}+", "")


def like_escape(text: str) -> str:
    """Escape LIKE wildcards so a search text matches literally."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def csv_cell(c: Column | str) -> Column:
    """F8: a quoted CSV cell, '"' doubled, null as an empty one."""
    return F.concat(F.lit('"'), F.replace(F.coalesce(col_of(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
