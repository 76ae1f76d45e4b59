"""MinHash near-dedup with odd sketches.

A document's set is that of its distinct 5-word shingles. MinHash samples in bands of rows
(``Scheme``, derived from the similarity asked for) give band keys; documents that share a
band key are candidates. The same samples
are folded into an odd sketch: a bitmap of ``SKETCH_BITS`` parities, each sample toggling
one bit. The population count of the XOR of two sketches is at most twice the number of
samples in which they differ, so a count above ``Scheme.most_odd`` rules a pair out before any set
is read. A second odd sketch folds the whole shingle set: its XOR count is at most the size
of the symmetric difference, which a link bounds by the set sizes, so this test is precise
for sets up to a few thousand shingles and never rules out a link. Pairs that remain are
confirmed on their full shingle sets.

No pairs are emitted wholesale within a group of candidates:

1. Rows with equal shingle sets are one class, represented by one row.
2. In each band group every class is compared with one leader, the member that shares most
   band keys over all its groups (the original of a set of edited copies, as a rule).
3. Links found so far give components. Only the classes of groups that still hold several
   components are looked at again. Of these, classes of different components are compared that have one of
   their rarest shingles in common, as all linked ones do (``rarest``); pairs inside a component
   cannot change the result. So no link that joins different components is lost to the choice of
   leaders, and documents that share a template, but not enough for a link, don't meet for it.

A pair at exactly the similarity asked for misses all bands with probability below ``MISS``
and differs in more samples than ``most_odd`` allows with probability below 1e-7; both fall
quickly above it. At 0.85 that takes 24 bands of 5 rows, at 0.8 27 bands of 4.

Defined results: a null text and a text without words have the empty set, which is linked
with nothing. With fewer than 5 words the whole sequence is the one shingle. Repeated rows
are linked copies. A null id counts as the largest: it is a component's id only if all its
ids are null. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punchspark.llm.common import BLOCK_ROWS, LOWER, blocks, checkpointed, keep_rows, mapped_words, text_bytes
from punchspark.llm.components import components

SHINGLE = 5
PERCENT = 85
MISS = 1e-6
MOST_BANDS = 28
SKETCH_BITS = 512
SET_BITS = 1024
HASH_BYTES = 1 << 18
SIGN_ROWS = 1024
"""Sets signed at a time, which bounds the bitmaps in a worker's memory."""
BUCKETS = 1 << 18
"""Buckets in which shingles are counted, to tell rare ones from frequent ones."""
FILTER_BITS = 1 << 26
"""Bits of the table that keeps texts which aren't needed from being dealt."""
HUB_PAIRS = 1000
"""Pairs of one set that are compared in one part."""


@dataclass(frozen=True)
class Scheme:
    """Bands, rows and sketch bound for links of at least ``percent`` hundredths similarity (1 to 99)."""

    percent: int = PERCENT

    def __post_init__(self) -> None:
        if not 1 <= self.percent <= 99:
            raise ValueError(f"percent must be 1 to 99, not {self.percent}")

    def _bands(self, rows: int) -> int:
        return math.ceil(math.log(MISS) / math.log1p(-((self.percent / 100) ** rows)))

    @property
    def rows(self) -> int:
        """The most rows, hence the fewest chance candidates, that ``MOST_BANDS`` bands can afford."""
        rows = 1
        while self._bands(rows + 1) <= MOST_BANDS:
            rows += 1
        return rows

    @property
    def bands(self) -> int:
        return self._bands(self.rows)

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def most_odd(self) -> int:
        """Twice the samples that differ at ``percent``, and six standard deviations."""
        differ = self.samples * (100 - self.percent)
        return 2 * int(differ / 100 + 6 * (differ * self.percent / 10_000) ** 0.5)


def _odd_numbers(n: int, seed: int) -> np.ndarray:
    """Fixed odd 64-bit multipliers, the same on every worker."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_BY_PLACE = _odd_numbers(4096, 1)
_BY_WORD = _odd_numbers(SHINGLE, 2)


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word: a random multiplier for every byte's place, then mixed.

    Numbers a byte take many times its size, so words are hashed in slices of about ``HASH_BYTES``.
    """
    data, offsets = text_bytes(words)
    out = np.zeros(len(words), np.uint64)
    start = 0
    while start < len(words):
        end = max(int(np.searchsorted(offsets, offsets[start] + HASH_BYTES, "right")) - 1, start + 1)
        out[start:end] = _hashes(data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start])
        start = end
    return out


def _hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    lengths = np.diff(offsets)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], lengths)
    factor = _BY_PLACE[place % len(_BY_PLACE)] + (place // len(_BY_PLACE)).astype(np.uint64) * np.uint64(2)
    value = (data.astype(np.uint64) + np.uint64(1)) * factor
    return mixed(np.add.reduceat(value, offsets[:-1]) + lengths.astype(np.uint64))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, bounds = mapped_words(texts, LOWER)
    hashed = word_hashes(words)
    if len(hashed) >= SHINGLE:
        n = len(hashed) - SHINGLE + 1
        rolled = np.zeros(n, np.uint64)
        for j in range(SHINGLE):
            rolled += hashed[j : j + n] * _BY_WORD[j]
        rolled = mixed(rolled)
    sets = []
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if e - s >= SHINGLE:
            own = np.unique(rolled[s : e - SHINGLE + 1])
        elif e > s:
            own = mixed((hashed[s:e] * _BY_WORD[: e - s]).sum(dtype=np.uint64, keepdims=True) + np.uint64(e - s))
        else:
            own = hashed[:0]
        sets.append(own)
    return sets


def signatures(sets: list[np.ndarray], scheme: Scheme = Scheme()) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, both odd sketches as 64-bit words) of sets that aren't empty."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    samples, bands, rows = scheme.samples, scheme.bands, scheme.rows
    by_sample, by_row = _odd_numbers(samples, 3), _odd_numbers(rows, 4)
    least = np.empty((samples, len(sets)), np.uint64)
    for i in range(samples):
        least[i] = np.minimum.reduceat(flat * by_sample[i], starts)
    least = mixed(least ^ np.arange(samples, dtype=np.uint64)[:, None])
    keys = mixed((least.reshape(bands, rows, -1) * by_row[None, :, None]).sum(axis=1, dtype=np.uint64)).T
    places = (least % np.uint64(SKETCH_BITS)).astype(np.int64) + np.arange(len(sets)) * SKETCH_BITS
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    whole = (flat % np.uint64(SET_BITS)).astype(np.int64) + owner * SET_BITS
    return keys, np.concatenate([_parities(places.ravel(), SKETCH_BITS, len(sets)), _parities(whole, SET_BITS, len(sets))], axis=1)


def _parities(places: np.ndarray, bits: int, n: int) -> np.ndarray:
    """n bitmaps of parities, as 64-bit words, of the places toggled."""
    odd = (np.bincount(places, minlength=n * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, bits), axis=1).view(np.uint64)


def _lists(rows: np.ndarray) -> pa.Array:
    """A list<long> array of equal rows."""
    flat = pa.array(np.ascontiguousarray(rows).view(np.int64).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), flat)


def _signer(scheme: Scheme) -> Callable:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for part in blocks(batches, "text"):
            sets = shingle_sets(part.column("text"))
            full = [k for k, s in enumerate(sets) if len(s)]
            bands, sketch = np.zeros((len(sets), scheme.bands), np.uint64), np.zeros((len(sets), (SKETCH_BITS + SET_BITS) // 64), np.uint64)
            for k in range(0, len(full), SIGN_ROWS):
                own = full[k : k + SIGN_ROWS]
                bands[own], sketch[own] = signatures([sets[j] for j in own], scheme)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(at, at + len(sets))),
                    part.column("id"),
                    pa.array([None if t is None else hashlib.sha256(t.encode()).hexdigest() for t in part.column("text").to_pylist()], pa.string()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    _lists(bands),
                    _lists(sketch),
                ],
                ["row", "id", "raw_sha256", "n_shingles", "class", "bands", "sketch"],
            )
            at += len(sets)

    return sign


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in blocks(batches, "text"):
        sets = shingle_sets(part.column("text"))
        yield pa.RecordBatch.from_arrays(
            [pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
            ["class", "shingles"],
        )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many sets of the task have a shingle in each bucket that any has."""
    counts = np.zeros(BUCKETS, np.int64)
    for part in blocks(batches, "shingles"):
        data, _ = text_bytes(part.column("shingles"))
        counts += np.bincount(np.frombuffer(data.tobytes(), np.uint64) % np.uint64(BUCKETS), minlength=BUCKETS)
    held = np.flatnonzero(counts)
    for k in range(0, len(held), BLOCK_ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(held[k : k + BLOCK_ROWS]), pa.array(counts[held[k : k + BLOCK_ROWS]])], ["bucket", "n"])


def rarest(own: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The rarest shingles of a set, so many that two sets similar enough have one of them in common.

    Similar sets share ``percent`` hundredths of either at least. Taken in one order of all shingles, the shingles
    of a set but the last so many less one then hold one that both have. Any order will do; rare ones first meet least.
    """
    n = len(own) + 1 - -(-percent * len(own) // 100)
    return own[np.lexsort((own, counts[(own % np.uint64(BUCKETS)).astype(np.int64)]))[:n]]


def _prefixes(counts: Broadcast, percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "shingles"):
            first = [rarest(np.frombuffer(s, np.uint64), counts.value, percent) for s in part.column("shingles").to_pylist()]
            at = np.repeat(np.arange(len(first)), [len(f) for f in first])
            rows = [part.column(c).take(pa.array(at)) for c in ("node", "component")]
            yield pa.RecordBatch.from_arrays([*rows, pa.array(np.concatenate(first).view(np.int64))], ["node", "component", "shingle"])

    return run


def _confirmer(percent: int) -> Callable:
    """Keeps pairs whose full sets are similar enough. A set of ``hub`` comes first, those compared with it after it."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for batch in blocks(batches, "shingles"):
            links = []
            for a, salt, b, s in zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "b", "shingles"))):
                other = np.frombuffer(s, np.uint64)
                if b is None:
                    hub, own = (a, salt), other
                    continue
                if hub != (a, salt):
                    raise ValueError(f"pair ({a}, {b}) came without the set of {a}")
                both = np.concatenate([own, other])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(own) + len(other) - shared):
                    links.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return confirm


def _able(scheme: Scheme = Scheme()) -> Column:
    """What sizes and odd sketches of a pair's sides a and b leave possible."""
    odd = [F.bit_count(F.col("sketch_a")[k].bitwiseXOR(F.col("sketch_b")[k])) for k in range((SKETCH_BITS + SET_BITS) // 64)]
    samples, whole = (sum(part[1:], part[0]) for part in (odd[: SKETCH_BITS // 64], odd[SKETCH_BITS // 64 :]))
    percent = scheme.percent
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return sizes & (samples <= scheme.most_odd) & ((100 + percent) * whole <= (100 - percent) * (F.col("n_a") + F.col("n_b")))


def _possible(pairs: DataFrame, reps: DataFrame, scheme: Scheme) -> DataFrame:
    """Pairs (a, b) that sizes and odd sketches leave possible, with the classes of both."""
    side = lambda s: reps.select(F.col("node").alias(s), F.col("class").alias(f"class_{s}"), F.col("n_shingles").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(_able(scheme)).select("a", "b", "class_a", "class_b")


def _apart(df: DataFrame) -> DataFrame:
    """A checkpoint with columns of its own, so that it can be joined with what it was made of in every plan."""
    done = checkpointed(df)
    return done.select(*[F.col(c).alias(c) for c in done.columns])


def _maybe_among(wanted: DataFrame, *names: str) -> Callable:
    """A filter that lets through all keys of ``wanted`` and few others, from a bit table of ``FILTER_BITS``.

    Its size is fixed; with very many keys it lets more of the others through, and the join after it is as without.
    """
    place = lambda *c: F.pmod(F.xxhash64(*c), F.lit(FILTER_BITS)) + 1
    at = wanted.select(place(*names).alias("at"))
    parts = at.groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).toArrow()
    table = np.zeros((FILTER_BITS >> 15, 1 << 12), np.uint8)
    for part, bits in zip(parts.column("part").to_pylist(), parts.column("bits").to_pylist()):
        table[part - 1] = np.frombuffer(bits, np.uint8)
    shared = wanted.sparkSession.sparkContext.broadcast(table.ravel())

    @F.arrow_udf("boolean")
    def maybe(at: pa.Array) -> pa.Array:
        x = at.to_numpy(zero_copy_only=False) - 1
        return pa.array((shared.value[x >> 3] >> (x & 7).astype(np.uint8)) & 1 == 1)

    return lambda *c: maybe(place(*c))


def _sets_of(nodes: DataFrame, reps: DataFrame, rows: DataFrame) -> DataFrame:
    """(class, shingles): the full sets of ``nodes``, made again from the texts needed; few others are dealt."""
    wanted = _apart(reps.join(nodes, "node", "left_semi").select(F.col("id").alias("want"), F.col("raw_sha256").alias("want_sha")).distinct())
    maybe = _maybe_among(wanted, "want", "want_sha")
    texts = rows.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256)).where(maybe("id", "sha"))
    texts = texts.join(wanted, F.col("id").eqNullSafe(F.col("want")) & (F.col("sha") == F.col("want_sha")), "left_semi").select("text")
    return texts.mapInArrow(_sets, "class binary, shingles binary").dropDuplicates(["class"])


def _confirmed(pairs: DataFrame, sets: DataFrame, scheme: Scheme) -> DataFrame:
    """Links among ``pairs`` (a, b, class_a, class_b), on full sets (class, shingles).

    The pairs of one a are dealt in parts of about ``HUB_PAIRS``, and the set of a goes once to each part.
    """
    parts = pairs.groupBy("a", "class_a").agg(F.ceil(F.count(F.lit(1)) / HUB_PAIRS).alias("parts"))
    own = parts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), F.col("class_a").alias("class"))
    dealt = pairs.join(parts.select("a", "parts"), "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("salt"), "b", F.col("class_b").alias("class"))
    full = own.unionAll(dealt).join(sets, "class").select("a", "salt", "b", "shingles")
    ordered = full.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return ordered.mapInArrow(_confirmer(scheme.percent), "a long, b long")


def _across(opened: DataFrame, reps: DataFrame, scheme: Scheme) -> DataFrame:
    """Possible pairs (a, b, class_a, class_b) from different components that share one of their rarest shingles, of ``opened`` (node, component, class, shingles).

    No link is missed. A passage that many documents have is among the rarest shingles of those only that
    hold little else, so the documents of one template don't meet over it.
    """
    tally = opened.select("shingles").mapInArrow(_counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, np.int64)
    counts[tally.column("bucket").to_numpy()] = tally.column("n").to_numpy()
    shared = opened.sparkSession.sparkContext.broadcast(counts)  # BUCKETS numbers, however many documents there are
    first = opened.select("node", "component", "shingles").mapInArrow(_prefixes(shared, scheme.percent), "node long, component long, shingle long")
    met = first.groupBy("shingle").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 != c1").select("shingle")
    met = first.join(met, "shingle", "left_semi").join(reps.select("node", "class", "n_shingles", "sketch"), "node")
    side = lambda s: met.select("shingle", *[F.col(c).alias(f"{c}_{s}") for c in ("component", "class", "sketch")], F.col("node").alias(s), F.col("n_shingles").alias(f"n_{s}"))
    able = (F.col("a") < F.col("b")) & (F.col("component_a") != F.col("component_b")) & _able(scheme)
    return side("a").join(side("b"), "shingle").where(able).select("a", "b", "class_a", "class_b").distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept, raw_sha256 (null for a null text), component (null without shingles).

    Linked are rows whose sets have at least ``percent`` hundredths of their union in common.
    """
    scheme = Scheme(percent)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    signed = checkpointed(rows.mapInArrow(_signer(scheme), "row long, id long, raw_sha256 string, n_shingles long, class binary, bands array<long>, sketch array<long>"))
    full = signed.where("n_shingles > 0")
    classes = full.groupBy("class").agg(F.min("row").alias("node"), F.min("id").alias("least_id"))
    reps = full.join(classes.select("node"), full.row == F.col("node")).select("node", "id", "raw_sha256", "n_shingles", "class", "sketch", "bands")

    keys = reps.select("node", F.posexplode("bands").alias("band", "key"))
    shared = keys.groupBy("band", "key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = _apart(keys.join(shared, ["band", "key"]))
    score = members.groupBy("node").agg(F.sum("members").alias("score"))
    members = members.join(score, "node").select("node", "band", "key", "score")
    lead = members.groupBy("band", "key").agg(F.max(F.struct("score", "node")).alias("lead"))
    stars = members.join(lead, ["band", "key"]).select(F.col("lead.node").alias("a"), F.col("node").alias("b")).where("a != b").distinct()
    tried = _apart(_possible(stars, reps, scheme))
    ends = tried.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    links = checkpointed(_confirmed(tried, _sets_of(ends, reps, rows), scheme))
    found = components(links)

    # groups that still hold several components: every possible pair across them
    labelled = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_groups = labelled.groupBy("band", "key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 != c1")
    rest = _apart(labelled.join(open_groups, ["band", "key"], "left_semi").select("node", "component").distinct())
    if not rest.isEmpty():
        sets = _sets_of(rest.select("node"), reps, rows)
        opened = _apart(rest.join(reps.select("node", "class"), "node").join(sets, "class"))
        done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        across = _apart(_across(opened, reps, scheme).join(done, ["a", "b"], "left_anti"))
        more = checkpointed(_confirmed(across, opened.select("class", "shingles"), scheme))
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    labels = classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = labels.groupBy("component").agg(F.min("least_id").alias("component_id"))
    labels = labels.join(best, "component").select("class", "component_id", "component")
    out = full.select("row", "id", "n_shingles", "raw_sha256", "class").join(labels, "class")
    out = out.select("row", "id", "n_shingles", "component_id", "raw_sha256", "component")
    alone = signed.where("n_shingles = 0").select("row", "id", "n_shingles", F.col("id").alias("component_id"), "raw_sha256", F.lit(None).alias("component"))
    return out.unionByName(alone).select("id", "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), "raw_sha256", "component")


def drop_near_copies(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each component of ``docs``, with all columns: that with the smallest id, then text digest."""
    kept = near_dedup(docs, percent=percent).where("kept")
    least = kept.where("component is not null").groupBy("component").agg(F.min(F.struct("id", "raw_sha256")).alias("least")).select("least.*")
    one = least.unionByName(kept.where("component is null").select("id", "raw_sha256"))
    return keep_rows(docs, one.select(F.col("id").alias("__id"), F.col("raw_sha256").alias("__digest")))
