"""Line dedup by content-defined chunks of lines; DataFrame functions only.

A rolling hash over the hashes of ``SPAN`` neighbouring lines decides after which lines a chunk
ends (one in ``SPACING`` on average), so boundaries depend on nearby lines alone and return to
step after an insertion. Below these chunks lies the finest level, overlapping chunks of two
lines at every line, since most repeated passages are shorter than two boundaries apart.

1. Chunks of both levels are hashed; a hash that comes again points to its first place (smallest
   id, then first line). Document, place and shift make a diagonal.
2. On a diagonal into another document, line hashes are compared line by line, so each confirmed
   chunk grows to the whole run that both documents share. Inside one document, neighbouring
   chunks of one shift are joined, and a run ends before it would meet its own source.
3. From its first line on, a document is parsed by the runs that begin at or before a line:
   that which reaches furthest is taken, and the parse goes on after it. So what goes is a
   run of two lines or more that occurs earlier as a whole.
4. Lines that are the source of a run that goes elsewhere stay in any case, so the source stays whole.
5. A run goes only after its bytes were compared with the bytes of its source.

The texts are dealt once, by document; the exchange serves sources and documents. Everything
before works on hashes of lines: a hot chunk is combined map-side and its places are joined to
one row, which adaptive execution splits.

Defined results: a null text counts as empty, which is one line and no repeat. Rows that
repeat id and text are the same place, and are cut alike. A null id comes last. Other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punchspark.llm.common import checkpointed

SPAN = 2
SPACING = 4
PLACE = ["id", "tie"]


def _ends_chunk(h: Column, i: Column) -> Column:
    """Whether a chunk ends after line i (from 1): the rolling hash of lines i - SPAN + 1 to i."""
    rolled = F.lit(0).cast("long")
    for k in range(SPAN):
        rolled = rolled + F.lit(31**k) * F.when(i > k, F.pmod(F.element_at(h, F.greatest(i - k, F.lit(1))), F.lit(1 << 31))).otherwise(F.lit(0))
    return F.pmod(F.xxhash64(rolled), F.lit(SPACING)) == 0


def chunks(hashed: DataFrame) -> DataFrame:
    """(id, tie, n, start, end, key) of the chunks of two lines or more of both levels; lines count from 1.

    Each step's columns are used more than once by the next, so the optimiser keeps the
    steps apart and no array is built again for every element.
    """
    ends = hashed.select(*PLACE, "h", F.filter(F.sequence(F.lit(1), F.size("h")), lambda i: (i == F.size("h")) | _ends_chunk(F.col("h"), i)).alias("ends"))
    zipped = F.arrays_zip(F.concat(F.array(F.lit(0)), F.slice("ends", 1, F.size("ends") - 1)).alias("before"), F.col("ends").alias("last"))
    coarse = F.transform(F.filter(zipped, lambda p: p["last"] - p["before"] > 2), lambda p: F.struct((p["before"] + 1).alias("start"), p["last"].alias("end")))
    pairs = F.transform(F.sequence(F.lit(1), F.size("h") - 1), lambda i: F.struct(i.alias("start"), (i + 1).alias("end")))
    spans = ends.where(F.size("h") > 1).select(*PLACE, "h", F.concat(coarse, pairs).alias("spans"))
    return spans.select(
        *PLACE, F.size("h").alias("n"), F.inline(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.xxhash64(F.slice(F.col("h"), s["start"], s["end"] - s["start"] + 1)).alias("key"))))
    )


def diagonals(hashed: DataFrame) -> DataFrame:
    """(id, tie, n, at, shift, spans): chunks of a document of n lines that occur first at ``at`` = (id, tie), ``shift`` lines further."""
    found = chunks(hashed)
    first = found.groupBy("key").agg(F.min(F.struct(*PLACE, "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first")
    later = found.join(first, "key").where(F.struct(*PLACE, "start") != F.col("first"))
    at, shift = F.struct("first.id", "first.tie").alias("at"), (F.col("first.start") - F.col("start")).alias("shift")
    return later.select(*PLACE, "n", at, shift, "start", "end").groupBy(*PLACE, "n", "at", "shift").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def _between(stops: Column) -> Column:
    """The runs of two lines or more between neighbouring stops."""
    pairs = F.transform(F.slice(stops, 1, F.size(stops) - 1), lambda m, k: F.struct((m + 1).alias("start"), (F.get(stops, k + 1) - 1).alias("end")))
    return F.filter(pairs, lambda r: r["end"] > r["start"])


def runs(hashed: DataFrame) -> DataFrame:
    """(id, tie, start, end, at, shift): runs of two lines or more that occur whole at an earlier place."""
    found = diagonals(hashed)
    own = F.struct(*PLACE) == F.col("at")
    theirs = hashed.select(F.struct(*PLACE).alias("at"), F.col("h").alias("other"))
    # of the other document only what can stand beside this one's lines is carried on; the join below keeps the
    # optimiser from cutting it out anew for every line
    reach = F.greatest(F.lit(0), F.col("shift"))
    both = found.where(~own).join(theirs, "at").select(*PLACE, "at", "shift", reach.alias("reach"), F.slice("other", reach + 1, F.col("n")).alias("other"))
    both = both.join(hashed, PLACE)
    meets = lambda i: F.get("other", i + F.col("shift") - F.col("reach") - 1).eqNullSafe(F.element_at("h", i)) & (i + F.col("shift") > F.col("reach"))
    stops = F.concat(F.array(F.lit(0)), F.filter(F.sequence(F.lit(1), F.size("h")), lambda i: ~meets(i)), F.array(F.size("h") + 1))
    grown = both.select(*PLACE, "at", "shift", stops.alias("stops")).select(*PLACE, "at", "shift", _between(F.col("stops")).alias("spans"))

    # pairs of one shift that follow one another are one run, which ends before its own source begins to be itself
    pairs = F.sort_array(F.transform(F.filter("spans", lambda s: s["end"] == s["start"] + 1), lambda s: s["start"]))
    joined = found.where(own).select(*PLACE, "at", "shift", "spans", pairs.alias("pairs"))
    begins = F.filter("pairs", lambda i, k: (k == 0) | (F.get("pairs", k - 1) < i - 1))
    ends = F.filter("pairs", lambda i, k: (k == F.size("pairs") - 1) | (F.get("pairs", k + 1) > i + 1))
    whole = F.concat(F.zip_with(begins, ends, lambda b, e: F.struct(b.alias("start"), (e + 1).alias("end"))), F.filter("spans", lambda s: s["end"] > s["start"] + 1))
    apart = F.transform(whole, lambda s: F.struct(s["start"].alias("start"), F.least(s["end"], s["start"] - F.col("shift") - 1).alias("end")))
    joined = joined.select(*PLACE, "at", "shift", apart.alias("spans"))
    every = grown.unionByName(joined).select(*PLACE, "at", "shift", F.inline("spans"))
    return every.where("end > start")


def parsed(found: DataFrame) -> DataFrame:
    """(id, tie, start, end, at, shift): disjoint runs of each document, by its leftmost furthest parse."""
    of_line = found.groupBy(*PLACE, "start").agg(F.max(F.struct("end", "at", "shift")).alias("best"))  # the furthest from each line
    doc = of_line.groupBy(*PLACE).agg(F.sort_array(F.collect_list(F.struct("start", "best"))).alias("runs"))
    span = "struct<start:int,end:int,at:struct<id:bigint,tie:bigint>,shift:int>"
    kind = f"struct<p:int,best:struct<end:int,at:struct<id:bigint,tie:bigint>,shift:int>,done:array<{span}>>"
    taken = lambda s: F.struct(s["p"].alias("start"), s["best"]["end"].alias("end"), s["best"]["at"].alias("at"), s["best"]["shift"].alias("shift"))
    able = lambda s: F.coalesce(s["best"]["end"] > s["p"], F.lit(False))

    def closed(s: Column) -> Column:
        """What is parsed so far, its pending run taken."""
        return F.when(able(s), F.concat(s["done"], F.array(taken(s)))).otherwise(s["done"])

    def step(s: Column, r: Column) -> Column:
        after = F.when(able(s), F.greatest(s["best"]["end"] + 1, r["start"])).otherwise(r["start"])
        begin = F.struct(after.alias("p"), r["best"].alias("best"), closed(s).alias("done"))
        # a run that ends before the parse has nothing to offer
        further = F.struct(s["p"].alias("p"), F.when(F.coalesce(s["best"]["end"] >= r["best"]["end"], F.lit(False)), s["best"]).otherwise(r["best"]).alias("best"), s["done"].alias("done"))
        return F.when(r["start"] > s["p"], begin).otherwise(further).cast(kind)

    start = F.struct(F.lit(1).alias("p"), F.lit(None).cast("struct<end:int,at:struct<id:bigint,tie:bigint>,shift:int>").alias("best"), F.array().cast(f"array<{span}>").alias("done")).cast(kind)
    return doc.select(*PLACE, F.inline(F.aggregate("runs", start, step, closed)))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed_chunks (runs of removed lines), n_removed_lines, kept_text (null for a null text)."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("given"))
    text = F.coalesce("given", F.lit(""))
    tie = F.coalesce(F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("long"), F.lit(0))
    rows = rows.select("doc_id", "given", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), tie.alias("tie"))
    lines = F.split(text, "\n", -1)

    # rows that repeat id and text are one place
    hashed = checkpointed(rows.select(*PLACE, F.transform(lines, lambda s: F.xxhash64(s)).alias("h")).dropDuplicates(PLACE))
    pieces = checkpointed(parsed(runs(hashed)))
    moved = pieces.select(*PLACE, "start", "end", F.col("at.id").alias("id2"), F.col("at.tie").alias("tie2"), (F.col("start") + F.col("shift")).alias("start2"), (F.col("end") + F.col("shift")).alias("end2"))
    sources = moved.groupBy(F.col("id2").alias("id"), F.col("tie2").alias("tie"), "start2").agg(F.max("end2").alias("end2"))
    held = sources.select(*PLACE, F.explode(F.sequence("start2", "end2")).alias("line")).groupBy(*PLACE).agg(F.collect_set("line").alias("held"))

    # the texts, dealt once: to cut the sources, and to cut the documents
    dealt = rows.repartition(*PLACE)
    wanted = moved.select(F.col("id2").alias("id"), F.col("tie2").alias("tie"), "start2", "end2").distinct()
    wanted = wanted.groupBy(*PLACE).agg(F.collect_list(F.struct("start2", "end2")).alias("wanted"))
    origin = dealt.join(wanted, PLACE).select("doc_id", *PLACE, "wanted", lines.alias("lines")).dropDuplicates(["doc_id", *PLACE])  # all columns of dealt, so that its exchange is shared
    cut = F.transform("wanted", lambda w: F.struct(w["start2"].alias("start2"), w["end2"].alias("end2"), F.slice(F.col("lines"), w["start2"], w["end2"] - w["start2"] + 1).alias("bytes")))
    cut = origin.select(F.col("id").alias("id2"), F.col("tie").alias("tie2"), F.inline(cut))
    offered = moved.join(cut, ["id2", "tie2", "start2", "end2"]).groupBy(*PLACE).agg(F.sort_array(F.collect_set(F.struct("start", "end", "bytes"))).alias("offered"))
    marks = offered.join(held, PLACE, "left").select(*PLACE, "offered", F.coalesce("held", F.array().cast("array<int>")).alias("held"))

    joined = dealt.join(marks, PLACE, "left").select("doc_id", "given", lines.alias("lines"), "offered", "held")
    same = lambda o: F.slice(F.col("lines"), o["start"], o["end"] - o["start"] + 1) == o["bytes"]
    gone = F.flatten(F.transform(F.filter("offered", same), lambda o: F.sequence(o["start"], o["end"])))
    gone = F.coalesce(F.array_except(gone, F.col("held")), F.array().cast("array<int>"))
    # a line that stands alone after its neighbours were held back isn't a run
    run = F.filter("gone", lambda i, k: (F.get("gone", k - 1) == i - 1) | (F.get("gone", k + 1) == i + 1))
    marked = joined.select("doc_id", "given", "lines", gone.alias("gone")).select("doc_id", "given", "lines", F.coalesce(run, F.array().cast("array<int>")).alias("gone"))
    edges = marked.select("doc_id", "given", "lines", "gone", F.filter("gone", lambda i, k: (k == 0) | (F.get("gone", k - 1) < i - 1)).alias("starts"), F.filter("gone", lambda i, k: (k == F.size("gone") - 1) | (F.get("gone", k + 1) > i + 1)).alias("ends"))
    kept = F.flatten(F.zip_with(F.concat(F.array(F.lit(0)), "ends"), F.concat("starts", F.array(F.size("lines") + 1)), lambda a, b: F.slice(F.col("lines"), a + 1, b - a - 1)))
    return edges.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.size("starts").cast("long").alias("n_removed_chunks"),
        F.size("gone").cast("long").alias("n_removed_lines"),
        F.when(F.col("given").isNotNull(), F.array_join(kept, "\n")).alias("kept_text"),
    )
