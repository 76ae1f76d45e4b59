"""Header alias resolution.

A header matches an alias when both are equal after lower-casing and removing
all whitespace; dots are kept ('Staff No.' is not 'Staff No'). When two headers
normalise alike, the leftmost wins.

JS `getVal(a) || getVal(b) || ...` yields the first non-empty value; when none is
non-empty it yields the *last* alias's value: '' if that header exists, undefined
if not. ``AliasChain.defined`` reproduces that distinction, which the roster name
rules depend on.

Two cell sources are supported: a wide frame (one column per header, resolved
at plan time from ``df.columns``) and a long frame with a ``cells`` map whose
keys are already normalised (workbook rows, whose headers differ per file).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punchspark.functions.text import falsy_to_null


# JavaScript's \s also covers the BOM (U+FEFF), which Python's does not.
_JS_WS = re.compile(r"[\s\ufeff]")


def header_key(name: str) -> str:
    return _JS_WS.sub("", name.lower())


class WideCells:
    """Cells of a frame with one string column per header."""

    def __init__(self, columns: list[str]):
        self._by_key: dict[str, str] = {}
        for c in columns:
            self._by_key.setdefault(header_key(c), c)

    def get(self, alias: str) -> Column | None:
        c = self._by_key.get(header_key(alias))
        return F.col(f"`{c}`").cast("string") if c is not None else None

    def present(self, alias: str) -> Column:
        return F.lit(header_key(alias) in self._by_key)


class MapCells:
    """Cells held in a map<string,string> column keyed by normalised header."""

    def __init__(self, cells: str = "cells"):
        self._cells = F.col(cells)

    def get(self, alias: str) -> Column | None:
        return F.try_element_at(self._cells, F.lit(header_key(alias)))

    def present(self, alias: str) -> Column:
        return F.coalesce(F.map_contains_key(self._cells, F.lit(header_key(alias))), F.lit(False))


def cells_for(df: DataFrame):
    return MapCells() if "cells" in df.columns and dict(df.dtypes)["cells"].startswith("map") else WideCells(df.columns)


@dataclass
class AliasChain:
    value: Column  # first non-empty value, or null
    defined: Column  # JS result !== undefined


def resolve(cells, aliases: tuple[str, ...]) -> AliasChain:
    got = [cells.get(a) for a in aliases]
    vals = [falsy_to_null(g) for g in got if g is not None]
    value = F.coalesce(*vals) if vals else F.lit(None).cast("string")
    if len(vals) == 1:
        value = vals[0]
    defined = value.isNotNull() | cells.present(aliases[-1])
    return AliasChain(value, defined)
