"""Suffix-array dedup: removes every byte covered by a 100-byte string that also starts earlier.

A corpus-wide suffix array does not fit a shuffle (one position per byte is many times the
text), so positions are first dealt out by content, such that equal 100-byte strings meet in
one group, and each group gets its own suffix array:

1. *Deal.* Every 100-byte window belongs to the smallest hash among its 32-byte grams; the
   choice depends on the window's bytes alone, so equal windows choose equal grams. Neighbouring
   windows that choose the same gram form one context (100 to 168 bytes). A context is a
   (gram hash, context hash, place) entry, about one to 35 bytes of text.
2. *Pre-aggregate.* Of equal contexts (equal gram hash and context hash, 112 bits) only the
   first place goes on; all windows of the others start earlier elsewhere. This is done in
   each block of text before the shuffle and once more after it, so that a passage that a
   third of the documents share comes to one entry for each block of text.
3. *Sort.* Different contexts that share a gram are fetched from their documents, grouped by
   gram and put through the two-stage suffix sort (``suffix_array``): suffixes smaller than
   their successors are sorted directly, the others are induced by one scan over the buckets.
   Common prefixes of neighbours in the array then give the classes of equal windows, and all
   but the first place of a class are removed.
4. *Deal crowded grams again.* A line of 32 to 99 bytes that many documents share amid
   different text puts about one context a document on the same gram. Above ``GROUP`` contexts
   (or ``BLOCK_GROUP`` in one block of text, whose contexts are then spread by context hash and
   only a mark goes to the gram's bucket) all windows of the gram are dealt by their own digest
   (128 bits), with the first place kept in each block of text and once more after the shuffle.
   No suffix array then holds more than ``GROUP`` contexts of a gram.
5. *Collect.* The removed spans of a document are joined to its text.

Defined results: a null text counts as empty; texts under 100 bytes lose nothing. Places are
ordered by (id, digest of the text, offset), a null id last; of rows that repeat id and text
all but one count as later. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punchspark.llm.common import blocks, checkpointed, text_bytes
from punchspark.llm.near_dedup import mixed

LENGTH = 100
GRAM = 32
GRAMS = LENGTH - GRAM + 1
BLOCK = 32 << 20
"""Bytes of text in which equal contexts are pre-aggregated."""
CHUNK = 1 << 20
SORT_BYTES = 1 << 20
"""Bytes of contexts that go into one suffix array; it takes whole grams, each of ``GROUP`` contexts at most."""
GROUP = 1024
"""Contexts of one gram up to which they share a suffix array; above it, their windows are dealt one by one."""
BLOCK_GROUP = 64
"""The same within one block of text."""
HELD = 1 << 18
"""Entries of a bucket that are held before grams above the bound leave it."""
BUCKETS = 1024

_DRAWN = np.random.Generator(np.random.PCG64(77)).integers(0, 2**63, 300, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BY_BYTE, _BY_LEVEL, _BY_PART = _DRAWN[:256], _DRAWN[256:270], _DRAWN[270:280]
ENTRY = np.dtype([("gram", "<u8"), ("context", "<u8"), ("id", "<i8"), ("tie", "<i8"), ("start", "<i8"), ("end", "<i8")])


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes from each position on, by doubling."""
    h, m = _BY_BYTE[data], 1
    while m < GRAM:
        level = _BY_LEVEL[m.bit_length() - 1]
        h = h[:-m] * level + h[m:]
        m *= 2
    return mixed(h)


def _chunk_contexts(data: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, ...]:
    """(gram hash, context hash, start, end) of the contexts of the windows that start at the valid positions."""
    h = _gram_hashes(data)
    bits = np.uint64((1 << 22) - 1)
    least = (h & ~bits) | np.arange(len(h), dtype=np.uint64)
    m = 1
    while 2 * m <= GRAMS:
        least = np.minimum(least[:-m], least[m:])
        m *= 2
    if m < GRAMS:
        least = np.minimum(least[: len(least) - (GRAMS - m)], least[GRAMS - m :])
    starts = np.flatnonzero(valid)
    chosen = (least[starts] & bits).astype(np.int64)
    new = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    gram, start, end = h[chosen[first]], starts[first], starts[last] + LENGTH
    context = mixed((end - start).astype(np.uint64)) + h[end - GRAM] * _BY_PART[9]
    for j in range((LENGTH + GRAMS) // GRAM + 1):
        at = start + GRAM * j
        inside = at + GRAM <= end
        context[inside] += h[at[inside]] * _BY_PART[j]
    return gram >> np.uint64(16), mixed(context), start, end


def contexts(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """ENTRY records of all contexts of the documents in ``data``."""
    out = []
    for at in range(0, len(data), CHUNK):
        stop = min(at + CHUNK, len(data))
        piece = data[at : stop + LENGTH - 1]
        row = np.searchsorted(offsets, np.arange(at, stop), "right") - 1 if len(offsets) > 2 else np.zeros(stop - at, np.int64)
        valid = np.arange(at, stop) + LENGTH <= offsets[row + 1]
        if not valid.any():
            continue
        gram, context, start, end = _chunk_contexts(piece, valid)
        owner = row[start]
        e = np.empty(len(start), ENTRY)
        e["gram"], e["context"], e["id"], e["tie"] = gram, context, ids[owner], ties[owner]
        e["start"], e["end"] = start + at - offsets[owner], end + at - offsets[owner]
        out.append(e)
    return np.concatenate(out) if out else np.empty(0, ENTRY)


def first_places(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries at the first place of each context, the later ones), the former sorted by gram and context."""
    entries = entries[np.lexsort((entries["start"], entries["tie"], entries["id"], entries["context"], entries["gram"]))]
    same = np.zeros(len(entries), bool)
    same[1:] = (entries["gram"][1:] == entries["gram"][:-1]) & (entries["context"][1:] == entries["context"][:-1])
    first, later = entries[~same], entries[same]
    # rows that repeat id and text give the very same place again, which is no later one
    owner = np.cumsum(~same)[same] - 1
    again = (later["id"] == first["id"][owner]) & (later["tie"] == first["tie"][owner]) & (later["start"] == first["start"][owner])
    return first, later[~again]


def _spans(entries: np.ndarray) -> np.ndarray:
    """Entries with touching or overlapping spans of a document joined."""
    if not len(entries):
        return entries
    entries = entries[np.lexsort((entries["start"], entries["tie"], entries["id"]))]
    new = np.ones(len(entries), bool)
    # the spans are of windows whose starts ascend, and so do the ends
    new[1:] = (entries["id"][1:] != entries["id"][:-1]) | (entries["tie"][1:] != entries["tie"][:-1]) | (entries["start"][1:] > entries["end"][:-1])
    first = np.flatnonzero(new)
    out = entries[first].copy()
    out["end"] = entries["end"][np.concatenate([first[1:], [len(entries)]]) - 1]
    return out


def _packed(e: np.ndarray) -> bytes:
    """Entries column by column, which the shuffle compresses better than row by row."""
    return np.uint32(len(e)).tobytes() + b"".join(np.ascontiguousarray(e[c]).tobytes() for c in ENTRY.names)


def _unpacked(blob: bytes) -> np.ndarray:
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    e = np.empty(n, ENTRY)
    for k, c in enumerate(ENTRY.names):
        e[c] = np.frombuffer(blob, ENTRY[c], n, 4 + 8 * n * k)
    return e


def _by_bucket(entries: np.ndarray, by: str, buckets: int, kind: int) -> list[tuple[int, int, bytes]]:
    """(bucket, kind, packed entries) by the column that chooses the bucket."""
    if not len(entries):
        return []
    bucket = (entries[by] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    entries, bucket = entries[order], bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    return [(int(bucket[c]), kind, _packed(part)) for c, part in zip(cuts, np.split(entries, cuts[1:]))]


def _per_gram(entries: np.ndarray) -> np.ndarray:
    """For each entry, the number of entries of its gram; sorted by gram."""
    cuts = np.flatnonzero(np.concatenate([[True], entries["gram"][1:] != entries["gram"][:-1]])) if len(entries) else np.empty(0, np.int64)
    sizes = np.diff(np.append(cuts, len(entries)))
    return np.repeat(sizes, sizes)


def _deal(buckets: int):
    """Kind 0: removed spans; 1: contexts, by gram; 2: contexts of crowded grams, by context; 3: a mark of each such gram, by gram."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text", BLOCK):
            data, offsets = text_bytes(part.column("text"))
            ids, ties = (part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "tie"))
            first, later = first_places(contexts(data, offsets, ids, ties))
            later = _spans(later)
            crowded = _per_gram(first) > BLOCK_GROUP
            marks = first[crowded]
            marks = marks[np.concatenate([[True], marks["gram"][1:] != marks["gram"][:-1]])] if len(marks) else marks
            rows = _by_bucket(first[~crowded], "gram", buckets, 1) + _by_bucket(first[crowded], "context", buckets, 2) + _by_bucket(marks, "gram", buckets, 3)
            if len(later):
                rows.append((int(later["id"][0] % buckets), 0, _packed(later)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["bucket", "kind", "blob"])

    return deal


def _entry_batch(e: np.ndarray, kind: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(e), kind, np.int32)), *(pa.array(np.ascontiguousarray(e[c]).astype(np.int64)) for c in ("gram", "id", "tie", "start", "end"))],
        ["kind", "gram", "id", "tie", "start", "end"],
    )


class _Bucket:
    """The entries of one bucket, of which only grams within the bound stay until its end."""

    def __init__(self):
        self.own, self.spread, self.crowded = [], [], np.empty(0, np.uint64)
        self.size, self.limit = 0, HELD

    def add(self, kind: int, entries: np.ndarray) -> Iterator[pa.RecordBatch]:
        if kind == 3:
            self.crowded = np.union1d(self.crowded, entries["gram"])
            return
        (self.own if kind == 1 else self.spread).append(entries)
        self.size += len(entries)
        if self.size >= self.limit:
            yield from self.settle(False)

    def settle(self, last: bool = True) -> Iterator[pa.RecordBatch]:
        """Kind 0: removed spans; 1: contexts for the suffix arrays (at the end); 2: contexts whose windows are dealt again."""
        for held in (self.spread, self.own):
            first, later = first_places(np.concatenate(held)) if held else (np.empty(0, ENTRY),) * 2
            if len(later):
                yield _entry_batch(_spans(later), 0)
            if held is self.spread:
                again, rest = first, first[:0]
            else:
                count = _per_gram(first)
                self.crowded = np.union1d(self.crowded, first["gram"][count > GROUP])
                crowded = np.isin(first["gram"], self.crowded)
                again, rest = first[crowded], first[~crowded]
                if last and (shared := count[~crowded] > 1).any():
                    yield _entry_batch(rest[shared], 1)
            if len(again):
                yield _entry_batch(again, 2)
        self.spread, self.own, self.size = [], [rest], len(rest)
        self.limit = max(HELD, 2 * self.size)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: removed spans; kind 1: first places of different contexts that share a gram; kind 2: those of crowded grams. Rows come bucket by bucket."""
    held, bucket = _Bucket(), None
    for batch in batches:
        for b, kind, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "blob"))):
            if kind == 0:
                yield _entry_batch(_unpacked(blob), 0)
                continue
            if b != bucket:
                yield from held.settle()
                held, bucket = _Bucket(), b
            yield from held.add(kind, _unpacked(blob))
    yield from held.settle()


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` (symbols 0 to 256, 0 ending a string) by their suffixes, right in the first ``depth`` symbols.

    Two-stage sorting. A suffix is small if it is smaller than the one that starts a symbol
    later. Small suffixes are sorted directly. A suffix that is not small follows from the
    order of its successor, so one scan over the buckets of first symbols, from low to high,
    places them: in each bucket they come before the small ones, in the order in which the
    scan meets their successors. A bucket is scanned as one array at a time.
    """
    n = len(text)
    differs = np.concatenate([text[:-1] != text[1:], [True]])
    rises = np.concatenate([text[:-1] < text[1:], [True]])
    at = np.where(differs, np.arange(n), n)
    following = np.minimum.accumulate(at[::-1])[::-1]  # the end of the run of equal symbols
    small = rises[following] | (text == 0)
    direct = np.flatnonzero(small & (text > 0))
    # Symbols of one string fit a byte each, and a string's end is the end of its slice.
    whole = (np.maximum(text, 1) - 1).astype(np.uint8).tobytes()
    zeros = np.flatnonzero(text == 0)
    ends = np.minimum(zeros[np.searchsorted(zeros, direct)], direct + depth).tolist() if len(direct) else []
    keys = [whole[s:e] for s, e in zip(direct.tolist(), ends)]
    order = sorted(range(len(keys)), key=keys.__getitem__)
    direct = direct[np.array(order, np.int64)] if len(order) else direct
    symbols, cuts = np.unique(text[direct], return_index=True)
    own = dict(zip(symbols.tolist(), np.split(direct, cuts[1:])))
    own[0] = zeros
    induced: dict[int, list[np.ndarray]] = {}
    out = []
    none = np.empty(0, np.int64)

    def induce(places: np.ndarray, symbol: int) -> np.ndarray:
        """Appends the large predecessors to their buckets, and returns those in the same bucket."""
        before = places[places > 0] - 1
        before = before[~small[before]]
        heads = text[before]
        higher = before[heads > symbol]
        if len(higher):
            heads_up = text[higher]
            rank = np.argsort(heads_up, kind="stable")
            higher, heads_up = higher[rank], heads_up[rank]
            edge = np.flatnonzero(np.concatenate([[True], heads_up[1:] != heads_up[:-1]]))
            for c, p in zip(heads_up[edge].tolist(), np.split(higher, edge[1:])):
                induced.setdefault(c, []).append(p)
        return before[heads == symbol]

    for symbol in range(int(text.max()) + 1 if n else 0):
        wave = np.concatenate(induced.pop(symbol)) if symbol in induced else none
        while len(wave):
            out.append(wave)
            wave = induce(wave, symbol)
        if symbol in own:
            out.append(own[symbol])
            induce(own[symbol], symbol)
    return np.concatenate(out) if out else none


def equal_neighbours(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place of ``order`` but the first, whether it shares its first ``length`` symbols with the place before.

    All windows must lie inside ``text``. Common prefixes grow in step for all pairs still equal.
    """
    pairs = np.arange(1, len(order))
    for k in range(0, length, 4):
        for j in range(k, min(k + 4, length)):
            pairs = pairs[text[order[pairs] + j] == text[order[pairs - 1] + j]]
        if not len(pairs):
            break
    equal = np.zeros(max(len(order) - 1, 0), bool)
    equal[pairs - 1] = True
    return equal


def repeated_windows(strings: list[bytes], ids: np.ndarray, ties: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """ENTRY spans of the windows of these contexts that have an earlier place among them."""
    sizes = np.array([len(s) for s in strings])
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    text = np.zeros(int((sizes + 1).sum()), np.int16)
    for b, s in zip(begins.tolist(), strings):
        text[b : b + len(s)] = np.frombuffer(s, np.uint8)
        text[b : b + len(s)] += 1
    order = suffix_array(text, length)
    owner = np.searchsorted(begins, order, "right") - 1
    inside = order + length <= begins[owner] + sizes[owner]
    order, owner = order[inside], owner[inside]
    if len(order) < 2:
        return np.empty(0, ENTRY)
    group = np.concatenate([[0], np.cumsum(~equal_neighbours(text, order, length))])
    place = starts[owner] + order - begins[owner]
    rank = np.lexsort((place, ties[owner], ids[owner], group))
    first = np.ones(len(rank), bool)
    first[1:] = group[rank][1:] != group[rank][:-1]
    gone = rank[~first]
    out = np.zeros(len(gone), ENTRY)
    out["id"], out["tie"], out["start"], out["end"] = ids[owner[gone]], ties[owner[gone]], place[gone], place[gone] + length
    return _spans(out)


def _windows(raw: bytes, at: int, doc: int, tie: int) -> np.ndarray:
    """ENTRY records of the windows of a context at ``at``; gram and context hold the window's digest."""
    n = len(raw) - LENGTH + 1
    e = np.empty(n, ENTRY)
    digests = np.frombuffer(b"".join(hashlib.blake2b(raw[k : k + LENGTH], digest_size=16).digest() for k in range(n)), "<u8").reshape(n, 2)
    e["gram"], e["context"], e["id"], e["tie"] = digests[:, 0], digests[:, 1], doc, tie
    e["start"] = at + np.arange(n)
    e["end"] = e["start"] + LENGTH
    return e


def _fetch(buckets: int):
    """Kind 0: removed spans; 1: the bytes of the wanted contexts of each document; 2: windows of crowded grams, gram being their bucket."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text"):
            ids, ties, wants = (part.column(c).to_pylist() for c in ("id", "tie", "wants"))
            out, single = [], []
            for i, tie, wanted, text in zip(ids, ties, wants, part.column("text").to_pylist()):
                raw = text.encode()
                for w in wanted:
                    own = raw[w["start"] : w["end"]]
                    if w["kind"] == 1:
                        out.append((1, w["gram"], i, tie, w["start"], own))
                    else:
                        single.append(_windows(own, w["start"], i, tie))
            if single:
                first, later = first_places(np.concatenate(single))
                out += [(kind, b, 0, 0, 0, blob) for b, kind, blob in _by_bucket(first, "gram", buckets, 2)]
                if len(later):
                    out.append((0, int(later["id"][0] % buckets), 0, 0, 0, _packed(_spans(later))))
            if out:
                types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["kind", "gram", "id", "tie", "start", "bytes"])

    return fetch


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removed spans, from suffix arrays over the contexts of whole grams, and from equal windows; rows come by kind and gram."""

    def settle(rows: list) -> Iterator[pa.RecordBatch]:
        if rows[0][0] == 1:
            _, _, ids, ties, starts, strings = zip(*rows)
            spans = repeated_windows(list(strings), np.array(ids), np.array(ties), np.array(starts))
        else:
            entries = np.concatenate([_unpacked(r[5]) for r in rows])
            spans = _spans(entries if rows[0][0] == 0 else first_places(entries)[1])
        if len(spans):
            yield _entry_batch(spans, 0).select(["id", "tie", "start", "end"])

    held, size = [], 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("kind", "gram", "id", "tie", "start", "bytes"))):
            if held and (row[0] != held[-1][0] or row[1] != held[-1][1] and size >= SORT_BYTES):
                yield from settle(held)
                held, size = [], 0
            held.append(row)
            size += len(row[5])
    if held:
        yield from settle(held)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The result of each document."""
    for part in blocks(batches, "text"):
        out = []
        for doc, text, copy, spans, was_null in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "copy", "spans", "was_null"))):
            raw = text.encode()
            if copy > 1 and len(raw) >= LENGTH:
                merged = [(0, len(raw))]
            else:
                merged = []
                for s, e in sorted((x >> 32, x & 0xFFFFFFFF) for x in spans or ()):
                    if merged and s <= merged[-1][1]:
                        merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
                    else:
                        merged.append((s, e))
            kept, at = [], 0
            for s, e in merged:
                kept.append(raw[at:s])
                at = e
            kept.append(raw[at:])
            rest = b"".join(kept)
            out.append((doc, len(raw), len(raw) - len(rest), len(merged), hashlib.sha256(rest).hexdigest(), [x for m in merged for x in m], None if was_null else rest))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])


def _tie() -> Column:
    # never null, so that a join adds no null filter below the exchange of the texts, which both joins then share
    return F.coalesce(F.conv(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 15), 16, 10).cast("long"), F.lit(0))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end, ...), and kept (the bytes left; null for a null text)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), F.col("text").isNull().alias("was_null"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", _tie())
    buckets = max(BUCKETS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.select("id", "tie", "text").mapInArrow(_deal(buckets), "bucket int, kind int, blob binary")
    met = checkpointed(dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_meet, "kind int, gram long, id long, tie long, start long, end long"))

    # texts are dealt out by document once; both joins below use that exchange
    wants = met.where("kind > 0").groupBy("id", "tie").agg(F.collect_list(F.struct("kind", "gram", "start", "end")).alias("wants"))
    texts = rows.select("doc_id", "id", "tie", "was_null", "text").repartition("id", "tie")
    fetched = texts.join(wants, ["id", "tie"]).mapInArrow(_fetch(buckets), "kind int, gram long, id long, tie long, start long, bytes binary")
    sorted_out = fetched.repartition("kind", "gram").sortWithinPartitions("kind", "gram").mapInArrow(_sort, "id long, tie long, start long, end long")
    removed = met.where("kind = 0").select("id", "tie", "start", "end").unionByName(sorted_out)
    spans = removed.groupBy("id", "tie").agg(F.collect_list(F.shiftleft("start", 32).bitwiseOR(F.col("end"))).alias("spans"))
    copies = texts.withColumn("copy", F.row_number().over(Window.partitionBy("id", "tie").orderBy(F.lit(0))))
    joined = copies.join(spans, ["id", "tie"], "left").select("doc_id", "text", "copy", "spans", "was_null")
    done = joined.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>, kept binary")
    return done if with_text else done.drop("kept", "spans")
