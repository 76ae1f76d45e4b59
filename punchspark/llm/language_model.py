"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, scored from memory-mapped sorted hash arrays.

Counting, one shuffle an order, from the highest down:

* Vocabulary: word hashes (64 bits) are counted in every task and dealt by hash range; a shard is
  a sorted array of hashes with their counts. A word's id is its place in all shards together.
* Highest order: n-grams of ids are counted in every task and dealt by their context, so that a shard
  sees whole contexts: it merges the counts, writes its n-grams as a sorted array of hashes beside
  their counts, and the context figures of Kneser-Ney (total, and how many n-grams were seen once, twice
  and more often).
* Lower orders: each different n-gram gives one to the continuation count of its last n - 1 words, and these
  are dealt and merged like counts. N-grams that begin a text have no word before them, so they keep plain counts.
* Hot contexts: words of a share of 1 in ``HOT_SHARE`` or more (at most ``HOT_SHARE`` words, and the start
  of a text) are hot; a context of hot words alone is dealt by its last word too, over ``SALTS``
  shards, and its partial figures are summed by key.

Shards are files in the cluster's shared folder (spark.checkpoint.dir), each put in place by one
rename, so a task that runs twice does no harm. A model has as many shards as Spark has shuffle partitions. To score, a worker maps the files that its texts ask
for (read only, ``MAPS`` at a time) and looks sorted hashes up in them; pages are shared by all workers of a machine,
and no model is ever held whole in a worker or sent through the driver. The folder must be mounted under a path on all
machines (file:), as memory-mapping needs one.

The model: P(w|ctx) = max(c - D(c), 0) / total + gamma(ctx) * P(w|shorter ctx), with three discounts an order by the
counts of counts, down to 1 / (V + 1) for every word, known or not. Texts begin with a start symbol, which is context
only, and end with an end token, which is predicted.

Defined results: a null or empty text is its end token alone. A null id is held out of nothing and is learned from.
Repeated rows count as often as they come. Without any training text every token has probability 1. Other columns are ignored.
"""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punchspark.llm.common import LOWER, blocks, mapped_words
from punchspark.llm.near_dedup import mixed, word_hashes
from punchspark.session import ensure_checkpoint_dir

ORDER = 2
FOLDS, HELD_FOLD = 7, 2
HOT_SHARE, SALTS = 4096, 16
SCAN_BYTES = 2 << 20
FLUSH_ROWS = 1 << 21
"""N-grams, or words, that a task gathers before it deals them out."""
MAPS = 256
START, UNKNOWN = 0xFFFFFFFF, 0xFFFFFFFE
END_HASH = word_hashes(pa.array(["\n"]))[0]
"""No word holds white space."""
ID = np.dtype("<u4")
COUNTS, FIGURES, OPEN = "counts", "figures", "open"
DEALT = "kind string, width int, shard int, payload binary"
"""What goes from one stage to the next: counts of n-grams of a width, figures of an order for the driver, and
partial figures of contexts that are open, that is dealt over several shards."""


def held_out(id_col: str = "doc_id") -> Column:
    """Ids whose texts are never learned from."""
    crc = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary"))
    return F.coalesce(crc % FOLDS == HELD_FOLD, F.lit(False))


# ---------------------------------------------------------------------------
# Files
# ---------------------------------------------------------------------------


def shared_folder(spark) -> str:
    """A new folder below spark.checkpoint.dir, as a path that every worker can open."""
    url = urlparse(ensure_checkpoint_dir(spark))
    if url.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped models need a mounted spark.checkpoint.dir (file:), not {url.scheme}:")
    return os.path.join(unquote(url.path), f"kneser-ney-{uuid.uuid4()}")


def _save(folder: str, name: str, array: np.ndarray) -> None:
    """Write a file whole or not at all."""
    os.makedirs(folder, exist_ok=True)
    part = os.path.join(folder, f".{name}-{uuid.uuid4()}")
    with open(part, "wb") as out:
        np.save(out, array)
    os.replace(part, os.path.join(folder, f"{name}.npy"))


class Files:
    """The arrays of a folder, mapped when asked for; the least used of ``MAPS`` is let go."""

    def __init__(self, folder: str):
        self.folder, self.open = folder, OrderedDict()

    def __call__(self, name: str) -> np.ndarray:
        if name in self.open:
            self.open.move_to_end(name)
            return self.open[name]
        path = os.path.join(self.folder, f"{name}.npy")
        self.open[name] = np.load(path, mmap_mode="r") if os.path.exists(path) else np.empty(0, np.uint64)
        if len(self.open) > MAPS:
            self.open.popitem(last=False)
        return self.open[name]


def _places(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found, place) of each wanted key."""
    if not len(sorted_keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return np.asarray(sorted_keys[at]) == wanted, at


def _by_shard(shards: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, rows) of each shard that occurs."""
    order = np.argsort(shards, kind="stable")
    cuts = np.flatnonzero(np.diff(shards[order])) + 1
    for rows in np.split(order, cuts) if len(order) else []:
        yield int(shards[rows[0]]), rows


# ---------------------------------------------------------------------------
# Tokens
# ---------------------------------------------------------------------------


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, offsets) of texts: lower-cased words, and the end token after each text's last."""
    words, bounds = mapped_words(texts, LOWER)
    out = np.full(len(words) + len(texts), END_HASH)
    rows = np.repeat(np.arange(len(texts)), np.diff(bounds))
    out[np.arange(len(words)) + rows] = word_hashes(words)
    return out, bounds + np.arange(len(texts) + 1)


def _shard_of_word(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of equal width, so that the shards follow one another in order of hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


@dataclass
class Model:
    """Where a model lies, and its few figures of fixed size."""

    folder: str
    order: int
    shards: int
    offsets: np.ndarray
    train_tokens: int = 0
    flush_rows: int = FLUSH_ROWS
    hot: np.ndarray = field(default_factory=lambda: np.empty(0, ID))
    discounts: dict = field(default_factory=dict)
    unigrams: np.ndarray = field(default_factory=lambda: np.zeros(4, np.int64))

    @property
    def vocabulary(self) -> int:
        return int(self.offsets[-1])

    def ids(self, files: Files, hashes: np.ndarray) -> np.ndarray:
        """The id of each word; UNKNOWN for words outside the vocabulary."""
        distinct, back = np.unique(hashes, return_inverse=True)
        found = np.full(len(distinct), UNKNOWN, ID)
        for shard, rows in _by_shard(_shard_of_word(distinct, self.shards)):
            ok, at = _places(files(f"words-{shard}"), distinct[rows])
            found[rows[ok]] = (at[ok] + self.offsets[shard]).astype(ID)
        return found[back]

    def of_words(self, files: Files, name: str, ids: np.ndarray) -> np.ndarray:
        """A figure by word id, 0 for unknown words."""
        distinct, back = np.unique(ids, return_inverse=True)
        out = np.zeros(len(distinct), np.int64)
        known = np.flatnonzero(distinct < self.vocabulary)
        home = np.searchsorted(self.offsets, distinct[known], "right") - 1
        for shard, rows in _by_shard(home):
            values = files(f"{name}-{shard}")
            if len(values):
                out[known[rows]] = values[distinct[known[rows]] - self.offsets[shard]]
        return out[back]

    def shard_of(self, grams: np.ndarray) -> np.ndarray:
        """The shard of each n-gram: by its context, and by its last word too if the context is hot; of a word, its home."""
        if grams.shape[1] == 1:
            return np.searchsorted(self.offsets, grams[:, 0], "right") - 1
        key = keys_of(grams[:, :-1])
        hot = np.isin(grams[:, :-1], self.hot).all(axis=1)
        salt = mixed(grams[:, -1].astype(np.uint64)) % np.uint64(SALTS) + np.uint64(1)
        return (mixed(np.where(hot, key + salt, key)) % np.uint64(self.shards)).astype(np.int64)


def keys_of(grams: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of ids."""
    out = np.full(len(grams), grams.shape[1], np.uint64)
    for column in grams.T:
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64) + np.uint64(1))
    return out


def merged(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows in order, and their summed counts."""
    if not len(rows):
        return rows, counts
    if rows.shape[1] == 2:
        order = np.argsort(rows[:, 0].astype(np.uint64) << np.uint64(32) | rows[:, 1], kind="stable")
    else:
        order = np.lexsort(rows.T[::-1])
    rows, counts = rows[order], counts[order]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    return rows[fresh], np.add.reduceat(counts, np.flatnonzero(fresh))


def _pack(rows: np.ndarray, counts: np.ndarray) -> bytes:
    """Counts, then the columns of ids one after the other."""
    return counts.astype("<u8").tobytes() + np.ascontiguousarray(rows.T).tobytes()


def _unpack(payload: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(payload) // (8 + 4 * width)
    return np.frombuffer(payload, ID, offset=8 * n).reshape(width, n).T, np.frombuffer(payload, "<u8", n).astype(np.int64)


def _batch(rows: list[tuple[str, int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.binary()))], ["kind", "width", "shard", "payload"])


class Dealer:
    """Gathers counted rows of one width and deals them out, merged, whenever ``limit`` are held."""

    def __init__(self, width: int, shard_of: Callable[[np.ndarray], np.ndarray], limit: int):
        self.width, self.shard_of, self.limit, self.held, self.size = width, shard_of, limit, [], 0

    def add(self, rows: np.ndarray, counts: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        self.held.append(merged(rows, np.ones(len(rows), np.int64) if counts is None else counts))
        self.size += len(self.held[-1][0])
        if self.size >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            rows, counts = merged(np.concatenate([r for r, _ in self.held]), np.concatenate([c for _, c in self.held]))
            yield _batch([(COUNTS, self.width, s, _pack(rows[at], counts[at])) for s, at in _by_shard(self.shard_of(rows))])
        self.held, self.size = [], 0


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, Iterator[bytes]]]:
    """(kind, width, shard, payloads) of each group in sorted batches."""
    rows = ((k, w, s, p.as_buffer()) for b in batches for k, w, s, p in zip(*(b.column(c).to_pylist() for c in ("kind", "width", "shard")), b.column("payload")))
    for name, group in groupby(rows, key=lambda r: r[:3]):
        yield *name, (r[3] for r in group)


def _gathered(payloads: Iterator[bytes], width: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The merged rows of a shard; pieces are merged as they add up."""
    held, size = [], 0
    for payload in payloads:
        held.append(_unpack(payload, width))
        size += len(held[-1][0])
        if size >= 2 * limit:
            held = [merged(np.concatenate([r for r, _ in held]), np.concatenate([c for _, c in held]))]
            size = len(held[0][0]) // 2
    return merged(np.concatenate([r for r, _ in held]), np.concatenate([c for _, c in held]))


def _met(dealt: DataFrame, shards: int) -> DataFrame:
    """Rows of a kind, width and shard together."""
    return dealt.repartition(shards, "kind", "width", "shard").sortWithinPartitions("kind", "width", "shard")


def _slim(counts: np.ndarray) -> np.ndarray:
    """The same counts in as few bytes as they need."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def _counts_of_counts(counts: np.ndarray) -> bytes:
    """Rows seen once to four times, and the sum."""
    return np.append(np.bincount(np.minimum(counts, 5), minlength=6)[1:5], counts.sum()).astype("<i8").tobytes()


# ---------------------------------------------------------------------------
# Training
# ---------------------------------------------------------------------------


def _halves(hashes: np.ndarray) -> np.ndarray:
    return np.stack([hashes >> np.uint64(32), hashes & np.uint64(0xFFFFFFFF)], axis=1).astype(ID)


def _wholes(rows: np.ndarray) -> np.ndarray:
    return rows[:, 0].astype(np.uint64) << np.uint64(32) | rows[:, 1]


def _vocabulary(texts: DataFrame, order: int, shards: int, flush_rows: int, hot_share: int) -> Model:
    """The words of the texts with their counts, in files by hash range."""
    folder = shared_folder(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(2, lambda rows: _shard_of_word(_wholes(rows), shards), flush_rows)
        for part in blocks(batches, "text", SCAN_BYTES):
            yield from dealer.add(_halves(tokens(part.column("text"))[0]))
        yield from dealer.flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, shard, payloads in _groups(batches):
            rows, counts = _gathered(payloads, 2, flush_rows)
            _save(folder, f"words-{shard}", _wholes(rows))
            _save(folder, f"counts-{shard}", _slim(counts))
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (shard, len(rows), counts.sum())], ["shard", "words", "tokens"])

    sizes = np.zeros(shards, np.int64)
    total = 0
    for r in _met(texts.mapInArrow(count, DEALT), shards).mapInArrow(meet, "shard long, words long, tokens long").collect():  # one row a shard
        sizes[r.shard] = r.words
        total += r.tokens
    if sizes.sum() >= UNKNOWN:
        raise ValueError("word ids take four bytes: the vocabulary is too large")
    model = Model(folder, order, shards, np.concatenate([[0], np.cumsum(sizes)]), total, flush_rows)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(folder)
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                at = np.flatnonzero(files(f"counts-{shard}").astype(np.int64) * hot_share >= total)
                yield pa.RecordBatch.from_arrays([pa.array(at + model.offsets[shard], pa.int64())], ["id"])

    found = texts.sparkSession.range(shards).mapInArrow(frequent, "id long").collect()  # hot_share rows at most
    model.hot = np.array(sorted([r.id for r in found] + [START]), ID)
    return model


def _started(model: Model, files: Files, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of the tokens of each text, with the start symbol before the first."""
    hashes, bounds = tokens(texts)
    begins = bounds + np.arange(len(bounds))
    out = np.full(begins[-1], START, ID)
    inner = np.ones(begins[-1], bool)
    inner[begins[:-1]] = False
    out[inner] = model.ids(files, hashes)
    return out, begins


def _windows(ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(last places, rows of ids) of all n-grams of a width that stay in a text."""
    if len(ids) < width:
        return np.empty(0, np.int64), np.empty((0, width), ID)
    rows = np.lib.stride_tricks.sliding_window_view(ids, width)
    fits = (rows[:, 1:] != START).all(axis=1)
    return np.flatnonzero(fits) + width - 1, rows[fits]


def _count(model: Model) -> Callable:
    """N-grams of the highest order, and of lower ones those at the start of a text, dealt by context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(model.folder)
        dealers = {w: Dealer(w, model.shard_of, model.flush_rows) for w in range(2, model.order + 1)}
        for part in blocks(batches, "text", SCAN_BYTES):
            ids, _ = _started(model, files, part.column("text"))
            for width, dealer in dealers.items():
                rows = _windows(ids, width)[1]
                yield from dealer.add(rows if width == model.order else rows[rows[:, 0] == START])
        for dealer in dealers.values():
            yield from dealer.flush()

    return run


def _meet(model: Model, order: int) -> Callable:
    """Write the shards of an order, and deal out the continuation counts of the next lower one."""

    def contexts(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first row, key, total and how many counts are 1, 2 and more) of each context."""
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (rows[1:, :-1] != rows[:-1, :-1]).any(axis=1)
        at = np.flatnonzero(fresh)
        return at, keys_of(rows[at, :-1]), np.stack([np.add.reduceat(c, at) for c in (counts, counts == 1, counts == 2, counts >= 3)], axis=1).astype(np.int64)

    def write(name: str, shard: int, keys: np.ndarray, values: np.ndarray) -> None:
        by = np.argsort(keys)
        _save(model.folder, f"{name}-{order}-{shard}", keys[by])
        _save(model.folder, f"{name}of-{order}-{shard}", _slim(values[by]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower = Dealer(order - 1, model.shard_of, model.flush_rows)
        for kind, width, shard, payloads in _groups(batches):
            if kind == OPEN:
                _write_open(model, width, shard, payloads)
            elif kind == FIGURES or width < order:
                yield from (_batch([(kind, width, shard, bytes(p))]) for p in payloads)
            elif order == 1:
                rows, counts = _gathered(payloads, 1, model.flush_rows)
                dense = np.zeros(model.offsets[shard + 1] - model.offsets[shard], np.int64)
                dense[rows[:, 0] - model.offsets[shard]] = counts
                _save(model.folder, f"continuations-{shard}", _slim(dense))
                yield _batch([(FIGURES, 1, shard, _counts_of_counts(counts))])
            else:
                rows, counts = _gathered(payloads, order, model.flush_rows)
                write("grams", shard, keys_of(rows), counts)
                yield _batch([(FIGURES, order, shard, _counts_of_counts(counts))])
                at, keys, figures = contexts(rows, counts)
                hot = np.isin(rows[at, :-1], model.hot).all(axis=1)
                write("contexts", shard, keys[~hot], figures[~hot])
                home = (mixed(keys) % np.uint64(model.shards)).astype(np.int64)
                opened = np.concatenate([keys[:, None].astype("<i8"), figures], axis=1)[hot]
                yield _batch([(OPEN, order, s, opened[at].tobytes()) for s, at in _by_shard(home[hot])])
                yield from lower.add(rows[:, 1:])
        yield from lower.flush()

    return run


def _write_open(model: Model, order: int, shard: int, payloads: Iterator[bytes]) -> None:
    """The figures of open contexts: sums over the shards that hold them."""
    rows = np.concatenate([np.frombuffer(p, "<i8").reshape(-1, 5) for p in payloads])
    keys, back = np.unique(rows[:, 0].astype(np.uint64), return_inverse=True)
    figures = np.zeros((len(keys), 4), np.int64)
    np.add.at(figures, back, rows[:, 1:])
    _save(model.folder, f"open-{order}-{shard}", keys)
    _save(model.folder, f"openof-{order}-{shard}", figures)


def discounts(t: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts of 0, 1, 2 and more, from how many n-grams were seen once to four
    times; where these don't give any in range, half of the count, up to 1.5 for counts of 3 and more."""
    t1, t2, t3, t4 = (float(x) for x in t)
    if min(t1, t2, t3, t4) > 0:
        y = t1 / (t1 + 2 * t2)
        d = np.array([0.0, 1 - 2 * y * t2 / t1, 2 - 3 * y * t3 / t2, 3 - 4 * y * t4 / t3])
        if (d >= 0).all() and (d <= [0, 1, 2, 3]).all():
            return d
    return np.array([0.0, 0.5, 1.0, 1.5])


def train(texts: DataFrame, text_col: str = "text", order: int = ORDER, flush_rows: int = FLUSH_ROWS, hot_share: int = HOT_SHARE) -> Model:
    """A model of ``order`` (2 or more) of all texts, with its files in the cluster's shared folder."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = texts.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    model = _vocabulary(rows, order, shards, flush_rows, hot_share)
    dealt = rows.mapInArrow(_count(model), DEALT)
    for k in range(order, 0, -1):
        dealt = _met(dealt, shards).mapInArrow(_meet(model, k), DEALT)
    figures = {k: np.zeros(5, np.int64) for k in range(1, order + 1)}
    for r in dealt.collect():  # one row a shard and order
        figures[r.width] += np.frombuffer(r.payload, "<i8")
    model.discounts = {k: discounts(f[:4]) for k, f in figures.items()}
    once, twice, total = int(figures[1][0]), int(figures[1][1]), int(figures[1][4])
    model.unigrams = np.array([total, once, twice, model.vocabulary - once - twice])  # every word follows something
    return model


# ---------------------------------------------------------------------------
# Scoring
# ---------------------------------------------------------------------------


def _figures(model: Model, files: Files, order: int, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts of the n-grams, figures of their contexts), 0 for those never seen."""
    keys, context = keys_of(grams), keys_of(grams[:, :-1])
    counts, figures = np.zeros(len(grams), np.int64), np.zeros((len(grams), 4), np.int64)
    for shard, rows in _by_shard(model.shard_of(grams)):
        ok, at = _places(files(f"grams-{order}-{shard}"), keys[rows])
        if ok.any():
            counts[rows[ok]] = files(f"gramsof-{order}-{shard}")[at[ok]]
    hot = np.isin(grams[:, :-1], model.hot).all(axis=1)
    home = (mixed(context) % np.uint64(model.shards)).astype(np.int64)
    for name, mine in (("open", np.flatnonzero(hot)), ("contexts", np.flatnonzero(~hot))):
        for shard, rows in _by_shard(home[mine]):
            rows = mine[rows]
            ok, at = _places(files(f"{name}-{order}-{shard}"), context[rows])
            if ok.any():
                figures[rows[ok]] = files(f"{name}of-{order}-{shard}")[at[ok]]
    return counts, figures


def probabilities(model: Model, files: Files, ids: np.ndarray) -> np.ndarray:
    """P of each id given those before it; the places of start symbols hold nothing."""
    d = model.discounts[1]
    seen = model.of_words(files, "continuations", ids)
    total = max(int(model.unigrams[0]), 1)
    gamma = (d[1:] * model.unigrams[1:]).sum() / total if model.unigrams[0] else 1.0
    p = np.maximum(seen - d[np.minimum(seen, 3)], 0) / total + gamma / (model.vocabulary + 1)
    for k in range(2, model.order + 1):
        last, grams = _windows(ids, k)
        if not len(last):
            continue
        distinct, back = _different(grams)
        counts, figures = _figures(model, files, k, grams[distinct])
        d = model.discounts[k]
        total = np.maximum(figures[:, 0], 1)
        own = np.maximum(counts - d[np.minimum(counts, 3)], 0) / total
        gamma = np.where(figures[:, 0] > 0, (figures[:, 1:] * d[1:]).sum(axis=1) / total, 1.0)
        p[last] = own[back] + gamma[back] * p[last]
    return p


def _different(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of different rows, the number of each row among them), by key."""
    _, first, back = np.unique(keys_of(grams), return_index=True, return_inverse=True)
    return first, back


def _score(model: Model, files: Files, texts: pa.Array) -> list[np.ndarray]:
    """Per text: tokens, known tokens, and log10 probability by the add-one unigrams and by the model."""
    ids, begins = _started(model, files, texts)
    inner = ids != START
    bounds = begins[:-1] - np.arange(len(begins) - 1)
    seen = model.of_words(files, "counts", ids)[inner]
    base = np.log10((seen + 1) / (model.train_tokens + model.vocabulary + 1))
    own = np.log10(probabilities(model, files, ids)[inner])
    return [np.diff(np.append(bounds, inner.sum())), np.add.reduceat((seen > 0).astype(np.int64), bounds), np.add.reduceat(base, bounds), np.add.reduceat(own, bounds)]


SCORES = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, n_known, train_tokens, base_score, score (log10), and perplexity of a token."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a folder's name and a few numbers a shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(shared.value.folder)
        for part in blocks(batches, "text", SCAN_BYTES):
            n, known, base, own = _score(shared.value, files, part.column("text"))
            train = np.full(len(n), shared.value.train_tokens)
            columns = [pa.array(x, pa.int64()) for x in (n, known, train)] + [pa.array(x, pa.float64()) for x in (base, own, 10 ** (-own / n))]
            yield pa.RecordBatch.from_arrays([part.column("id"), *columns], ["id", *SCORES])

    schema = rows.select("id").schema
    for name in SCORES:
        schema = schema.add(name, "long" if name in SCORES[:3] else "double")
    return rows.mapInArrow(run, schema)
