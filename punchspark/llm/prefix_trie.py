"""Prefix trie of conversations by whole-sequence collapse; DataFrame functions, and one hash of end lists in Python.

Conversations are rebuilt turn by turn (``rebuilt``): light rows of a turn's digest and size.
Each turn's digest is hashed with its position, so the XOR of those hashes identifies a
sequence, whatever the order in which they are gathered: 120 bits of SHA-256.

1. Conversations with the same whole sequence collapse to one weighted sequence, represented by
   its smallest member; the members' ids are kept as an end list.
2. Running XORs over the representatives' turns name all their prefixes, which are the nodes.
   Sequences that are proper prefixes of another are dropped by an anti-join; the rest are leaves.
3. Weighted prefixes are aggregated by node. Every figure is a sum over the sequences that pass
   a node, so no node is ever sent to its ancestors: a subtree's bytes over all members are
   suffix sums, and its bytes over distinct nodes are counted by letting each node belong to the
   smallest sequence through it, whose own nodes are always a tail of it.

A conversation or an end list of any length is cut over partitions (``operators.ordering``);
groupings on hot prefixes are partial sums. An end list is kept in arrays of ``PIECE`` ids and
hashed as a stream of them, since its SHA-256 is of the whole list.

Defined results: turns are ordered by turn, null first, ties by the digest of role and text;
null roles and texts are empty. Turns without a conv_id belong to no conversation. Repeated rows
are turns of their own. Without conversations there are no nodes, not even a root. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punchspark.llm.common import checkpointed
from punchspark.operators.ordering import running, running_count, running_sum, running_xor

FAMILY = 5
HEADS = 9
PIECE = 4096
"""Ids of an end list in one array."""
KEY = ["depth", "k1", "k2"]


@dataclass(frozen=True)
class Trie:
    """``nodes`` (one row a node) and ``ends`` (depth, k1, k2, piece, conv_ids): the end lists, cut in pieces."""

    nodes: DataFrame
    ends: DataFrame


def _bits(digest: Column, at: int) -> Column:
    """60 bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, at, 15), 16, 10).cast("long")


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, turn digest, bytes of the text) of every turn in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn"),
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    placed = running(rows, ["conv_id"], [F.asc_nulls_first("turn"), F.asc("digest")], pos=running_count())
    return placed.select("conv_id", "pos", "digest", "bytes")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all conversations, rebuilt turns): (conv_id) and (conv_id, depth from 1, digest, bytes).

    Conversation c takes the first h turns of c - c % FAMILY, then its own after its first h;
    h = crc32(c) % HEADS, so only the first HEADS - 1 turns of a conversation are ever shared.
    """
    own = turns(conversations)
    base, heads = F.col("conv_id") - F.col("conv_id") % FAMILY, F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    sizes = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    short = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    all_of = sizes.select("conv_id", base.alias("base"), heads.alias("heads")).join(short, "base", "left")
    all_of = all_of.select("conv_id", "base", "heads", F.least("heads", F.coalesce("base_n", F.lit(0))).alias("taken"))
    first = own.where(F.col("pos") < HEADS).select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "digest", "bytes")
    shared = all_of.join(first, "base").where("depth <= heads").select("conv_id", "depth", "digest", "bytes")
    rest = own.join(all_of, "conv_id").where("pos > heads").select("conv_id", (F.col("pos") - F.col("heads") + F.col("taken")).alias("depth"), "digest", "bytes")
    return sizes.select("conv_id"), shared.unionByName(rest)


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each end list from its pieces in order; only a hash state is held."""
    key, state = None, None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            own = (row["depth"], row["k1"], row["k2"])
            text = ",".join(map(str, row["conv_ids"])).encode()
            if own == key:
                state.update(b"," + text)
                continue
            if key is not None:
                out.append((*key, state.hexdigest()))
            key, state = own, hashlib.sha256(text)
        yield _digests(out)
    if key is not None:
        yield _digests([(*key, state.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], [*KEY, "ends_sha256"])


def end_lists(sequences: DataFrame) -> DataFrame:
    """(depth, k1, k2, piece, conv_ids): the ascending ids of equal conversations, in arrays of PIECE at most."""
    placed = running(sequences.select(*KEY, "conv_id"), KEY, [F.asc("conv_id")], pos=running_count())
    pieces = placed.groupBy(*KEY, F.floor((F.col("pos") - 1) / PIECE).alias("piece"))
    return pieces.agg(F.sort_array(F.collect_list("conv_id")).alias("conv_ids"))


def prefix_trie(conversations: DataFrame) -> Trie:
    """The trie of the rebuilt conversations.

    Columns of a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (what storing each node once saves in its subtree, in bytes of text), ends_sha256; and
    k1, k2, by which ``ends`` names a node at its depth.
    """
    everyone, rows = rebuilt(conversations)
    mark = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("digest")).cast("binary"), 256)
    rows = checkpointed(rows.withColumn("mark", mark).select("conv_id", "depth", "bytes", _bits(F.col("mark"), 1).alias("e1"), _bits(F.col("mark"), 16).alias("e2")))

    # 1. whole sequences
    whole = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("depth"), F.bit_xor("e1").alias("k1"), F.bit_xor("e2").alias("k2"), F.sum("bytes").alias("total"))
    none = F.lit(0).cast("long")
    sequences = checkpointed(everyone.join(whole, "conv_id", "left").select("conv_id", *[F.coalesce(c, none).alias(c) for c in (*KEY, "total")]))
    reps = sequences.groupBy(*KEY).agg(F.count(F.lit(1)).alias("weight"), F.min("conv_id").alias("rep"), F.min("total").alias("total"))
    reps = checkpointed(reps.withColumnRenamed("depth", "length"))

    # 2. their prefixes
    own = rows.join(reps.select(F.col("rep").alias("conv_id")), "conv_id", "left_semi")
    named = running(own, ["conv_id"], [F.asc("depth")], k1=running_xor("e1"), k2=running_xor("e2"), upto=running_sum("bytes"))
    below = named.select(
        F.col("conv_id").alias("rep"),
        *KEY,
        F.col("k1").bitwiseXOR(F.col("e1")).alias("p1"),
        F.col("k2").bitwiseXOR(F.col("e2")).alias("p2"),
        "bytes",
        (F.col("upto") - F.col("bytes")).alias("before"),
    )
    root = reps.select("rep", *[none.alias(c) for c in KEY], *[F.lit(None).cast("long").alias(c) for c in ("p1", "p2")], none.alias("bytes"), none.alias("before"))
    about = reps.select("rep", "weight", "length", "total")
    prefixes = checkpointed(below.unionByName(root).join(about, "rep"))
    proper = prefixes.where("depth < length").select(*KEY).distinct()
    leaves = reps.select(F.col("length").alias("depth"), "k1", "k2", "rep").join(proper, KEY, "left_anti").select("rep", F.lit(1).alias("leaf"))

    # 3. nodes
    nodes = prefixes.groupBy(*KEY).agg(F.sum("weight").alias("n_convs"), F.min("rep").alias("conv_id"), *[F.min(c).alias(c) for c in ("p1", "p2", "before")])
    nodes = checkpointed(nodes)
    owned = nodes.groupBy(F.col("conv_id").alias("rep")).agg(F.min("before").alias("owned_before"))
    passing = prefixes.join(about.select("rep").join(owned, "rep", "left").join(leaves, "rep", "left"), "rep")
    all_bytes = F.col("weight") * (F.col("total") - F.col("before"))
    node_bytes = F.coalesce(F.col("total") - F.greatest("before", "owned_before"), none)
    node_bytes = F.when(F.col("owned_before").isNull(), none).otherwise(node_bytes)
    sums = passing.groupBy(*KEY).agg(F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"), F.sum(all_bytes - node_bytes).alias("saved_tokens"))

    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    ends = end_lists(sequences)
    hashed = ends.repartition(*KEY).sortWithinPartitions(*KEY, "piece").select(*KEY, "conv_ids")
    hashed = hashed.mapInArrow(_hash_ends, "depth long, k1 long, k2 long, ends_sha256 string")
    found = nodes.join(sums, KEY).join(children, KEY, "left").join(hashed, KEY, "left").join(parents, ["depth", "p1", "p2"], "left")
    return Trie(
        found.select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            F.coalesce("n_children", none).alias("n_children"),
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
            "k1",
            "k2",
        ),
        ends,
    )
