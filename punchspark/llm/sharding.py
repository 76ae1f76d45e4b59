"""Sharding on a consistent-hash ring with virtual nodes and bounded loads; DataFrame functions only.

Every shard has ``vnodes`` places on a ring of ``GRID`` cells. A key's hash gives its cell,
and the key belongs to the next virtual node clockwise. Loads are bounded: of n rows a shard
takes floor(n / shards) or one more, and what overflows a full shard continues clockwise to
the next virtual node of a shard that has room. So counts differ by one at most whatever the
keys are, and rows leave their own shard only where it is full.

Only the number of rows of each arc (between two virtual nodes) is brought to the driver:
``shards * vnodes`` numbers, however many rows there are. The walk around the ring turns
them into at most ``shards * (vnodes + 1)`` segments (arc, ranks, shard, first slot), a table of
proven size that is broadcast; a row finds its segment by its rank in its arc. Arcs are cut by
the hash of the id, so copies of a text, hot sources and the like do not gather in one. Ranks
are counted over a range partitioning that cuts an arc between partitions, so an id (or null)
that a large part of the rows share is spread as well.

Defined results: a null text counts as empty, a null id is a key of its own. Rows that agree
in id, text and size are interchangeable. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punchspark.operators.ordering import running, running_count

SHARDS, VNODES = 40, 128
GRID = 1 << 16


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16)


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(cell, shard) of the virtual nodes, clockwise."""
    return sorted((_hash(f"shard {s} node {v}") % GRID, s) for s in range(shards) for v in range(vnodes))


def walk(nodes: list[tuple[int, int]], loads: dict[int, int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Segments (arc, first rank, end rank, shard, first slot) of bounded loads."""
    n = sum(loads.values())
    room = [n // shards + (s < n % shards) for s in range(shards)]
    used = [0] * shards
    out = []
    for arc in sorted(loads):
        done, at = 0, arc
        while done < loads[arc]:
            shard = nodes[at % len(nodes)][1]
            take = min(room[shard] - used[shard], loads[arc] - done)
            if take > 0:
                out.append((arc, done, done + take, shard, used[shard]))
                used[shard] += take
                done += take
            at += 1
    return out


def _arc_of(nodes: list[tuple[int, int]], cell: Column) -> Column:
    """The number of the next virtual node clockwise: one lookup in a folded constant."""
    arcs, k = [], 0
    for c in range(GRID):
        while k < len(nodes) and nodes[k][0] < c:
            k += 1
        arcs.append(str(k % len(nodes)))
    return F.element_at(F.split(F.lit(",".join(arcs)), ","), (cell + 1).cast("int")).cast("int")


def shard(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null)."""
    spark, nodes = docs.sparkSession, ring(shards, vnodes)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("none"))
    place = F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        place.alias("place"),
    ).withColumn("arc", _arc_of(nodes, F.pmod("place", F.lit(GRID))))
    loads = {r.arc: r.n for r in rows.groupBy("arc").agg(F.count(F.lit(1)).alias("n")).collect()}
    segments = [dict(zip(("seg_arc", "lo", "hi", "shard", "base"), s)) for s in walk(nodes, loads, shards)]
    plan = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(segments)), "array<struct<seg_arc:int,lo:long,hi:long,shard:int,base:long>>")))
    order = [F.col(c) for c in ("place", "doc_id", "text_crc32", "size")]
    ranked = running(rows, ["arc"], order, rank=running_count()).withColumn("rank", F.col("rank") - 1)
    # proven size: at most shards * (vnodes + 1) segments
    placed = ranked.join(F.broadcast(plan), (F.col("arc") == F.col("seg_arc")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
