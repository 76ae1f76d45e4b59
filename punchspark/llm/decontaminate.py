"""Benchmark decontamination: broadcast hash sets of the benchmark's n-grams, scanned over every document.

Words are runs of characters outside the ASCII separators, with A-Z lower-cased. A window is
``n`` consecutive words of an item; an item of fewer words (but not none) is one window. The
benchmark is indexed in blocks, which stream through the driver and are broadcast. A worker holds
blocks of ``worker_words`` words at most (by estimate 200 bytes a word): a larger benchmark is
scanned for in rounds, and the hit words and items of the rounds before are checkpointed with the
documents and carried on, so the results are the same. In a task, a document's words become ids of
the block's vocabulary, windows of ids are hashed, looked up in the hash set, and each hit is
verified id by id against the window that it stands for.

Defined results: null and empty texts have no words and no hits. Items without words match
nothing. The windows of items with a null id hit like any other, and only their id is missing from
the items. A repeated document row or item row is handled like any other (equal item ids count
once). A column of ``docs`` that is named like one of the results gives way to it; other columns
are passed through.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punchspark.llm.common import LOWER, blocks, checkpointed, mapped_words

WINDOW = 13
BLOCK_WORDS = 500_000
"""Benchmark words in one broadcast block (about 100 MB on a worker at most)."""
WORKER_WORDS = 4 * BLOCK_WORDS
"""Benchmark words that a worker holds at a time."""

_KEPT = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
WORD_TABLE = bytes(b if b in _KEPT else 0x20 for b in LOWER)
WORD_PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class WindowIndex:
    """Windows of one block of items: vocabulary, and per window length the sorted hashes and the windows themselves."""

    def __init__(self, items: list[tuple[str | None, str]], n: int):
        words, bounds = mapped_words(pa.array([t for _, t in items], pa.string()), WORD_TABLE)
        coded = words.dictionary_encode()
        self.vocabulary = coded.dictionary
        ids = np.asarray(coded.indices).astype(np.int64)
        found: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
        for k, (item, _) in enumerate(items):
            own = ids[bounds[k] : bounds[k + 1]].tolist()
            size = min(n, len(own))
            for s in range(len(own) - size + 1 if size else 0):
                owners = found[size][tuple(own[s : s + size])]
                if item is not None:
                    owners.add(item)
        self.lengths = []
        for size, windows in sorted(found.items()):
            grams = np.array(list(windows), np.int64).reshape(len(windows), size)
            seed = 1
            while True:  # one window to a hash, so that a hit names the window to verify
                mult = _multipliers(size, seed)
                hashes = (grams.astype(np.uint64) * mult).sum(axis=1, dtype=np.uint64)
                if len(np.unique(hashes)) == len(hashes):
                    break
                seed += 1
            order = np.argsort(hashes)
            owners = list(windows.values())
            self.lengths.append((size, mult, hashes[order], grams[order], [sorted(owners[i]) for i in order]))

    def hits(self, words: pa.Array, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, list]]:
        """(window length, starts, window numbers, items by window) of the verified hits in these documents."""
        ids = pc.fill_null(pc.index_in(words, value_set=self.vocabulary), -1)
        ids = np.asarray(ids).astype(np.int64)
        unknown = np.concatenate([[0], np.cumsum(ids < 0)])
        ends = np.repeat(bounds[1:], np.diff(bounds))
        for size, mult, hashes, grams, owners in self.lengths:
            if len(ids) < size:
                continue
            starts = np.arange(len(ids) - size + 1)
            fits = (unknown[size:] == unknown[:-size]) & (starts + size <= ends[: len(starts)])
            starts = starts[fits]
            value = np.zeros(len(starts), np.uint64)
            for j in range(size):
                value += ids[starts + j].astype(np.uint64) * mult[j]
            at = np.minimum(np.searchsorted(hashes, value), len(hashes) - 1)
            same = hashes[at] == value
            starts, at = starts[same], at[same]
            true = np.ones(len(starts), bool)
            for j in range(size):
                true &= ids[starts + j] == grams[at, j]
            if true.any():
                yield size, starts[true], at[true], owners


def _multipliers(size: int, seed: int) -> np.ndarray:
    """Odd 64-bit multipliers, the same on every worker."""
    drawn = np.random.Generator(np.random.PCG64(1_000 * seed + size)).integers(0, 2**63, size, dtype=np.uint64)
    return drawn * np.uint64(2) + np.uint64(1)


def _item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[tuple[int, list[tuple[str | None, str]]]]:
    """(words, items) of blocks of about ``block_words`` words; the items stream through the driver one partition at a time.

    Words are counted from above, by half the characters.
    """
    items = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    held, size = [], 0
    for row in items.where("text is not null").toLocalIterator():
        held.append((row.id, row.text))
        size += len(row.text) // 2 + 1
        if size >= block_words:
            yield size, held
            held, size = [], 0
    if held:
        yield size, held


def _scan(texts: pa.Array, indexes: list, runs: list, named: list) -> tuple[np.ndarray, np.ndarray, list[set], np.ndarray, np.ndarray]:
    """Per document: words, hit words, items; and the hit mark of each word with the word bounds.

    ``runs`` and ``named`` are the hit runs (start, end, start, ...) and the items of earlier rounds, by document.
    """
    words, bounds = mapped_words(texts, WORD_TABLE)
    edge = np.zeros(len(words) + 1, np.int64)
    items = [set(own) for own in named]
    for k, own in enumerate(runs):
        if len(own):
            np.add.at(edge, bounds[k] + np.asarray(own, np.int64), np.tile([1, -1], len(own) // 2))
    for index in indexes:
        for size, starts, at, owners in index.value.hits(words, bounds):
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + size, -1)
            rows = np.searchsorted(bounds, starts, "right") - 1
            for row, window in np.unique(np.stack([rows, at], axis=1), axis=0).tolist():
                items[row].update(owners[window])
    hit = np.cumsum(edge[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(hit)])
    return np.diff(bounds), total[bounds[1:]] - total[bounds[:-1]], items, hit, bounds


def _runs(hit: np.ndarray) -> np.ndarray:
    """Starts and ends of the runs of hit words, in turn."""
    return np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))


def _without_spans(text: str, hit: np.ndarray) -> str:
    """The text without its hit words and what lies between neighbouring ones."""
    out, at, open_at = [], 0, None
    for k, m in enumerate(WORD_PATTERN.finditer(text)):
        if hit[k]:
            if open_at is None:
                out.append(text[at : m.start()])
                open_at = m.start()
            at = m.end()
        else:
            open_at = None
    out.append(text[at:])
    return "".join(out)


def _scanner(indexes: list, with_runs: bool, with_text: bool):
    """The UDF of one round: (text, runs, items) → n_words, n_hit, items, runs and the text without its hits."""
    fields = {"n_words": "int64", "n_hit": "int64", "items": object, "runs": object, "clean_text": object}

    @F.pandas_udf("n_words long, n_hit long, items array<string>, runs array<long>, clean_text string")
    def scan(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, runs, named in batches:
            whole = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string(), from_pandas=True)], ["text"])
            parts, done = [pd.DataFrame({c: pd.Series(dtype=t) for c, t in fields.items()})], 0
            for part in blocks(iter([whole]), "text"):
                end = done + part.num_rows
                words, hits, items, hit, bounds = _scan(part.column("text"), indexes, runs[done:end].tolist(), named[done:end].tolist())
                own = [hit[bounds[k] : bounds[k + 1]] for k in range(len(words))]
                rows = part.column("text").to_pylist() if with_text else [None] * len(words)
                clean = [_without_spans(t, own[k]) if t is not None and hits[k] else t for k, t in enumerate(rows)]
                kept = [_runs(h) if with_runs else [] for h in own]
                columns = (words, hits, [sorted(i) for i in items], kept, pd.Series(clean, dtype=object))
                parts.append(pd.DataFrame(dict(zip(fields, columns))))
                done = end
            yield pd.concat(parts[1:] or parts, ignore_index=True)

    return scan


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = WINDOW,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    prefix: str = "",
    clean_text: bool = False,
    block_words: int = BLOCK_WORDS,
    worker_words: int = WORKER_WORDS,
) -> DataFrame:
    """``docs`` with n_words, n_hit, items (sorted as strings), contaminated, and clean_text if asked, in columns named with ``prefix``.

    ``contaminated``: at least a twentieth of the words are hit. ``clean_text`` is the text
    with the hit spans taken out (null stays null).
    """
    sc = docs.sparkSession.sparkContext
    own = [F.col(f"`{c}`") for c in docs.columns]
    text = F.col(f"__row.`{text_col}`").cast("string")
    rows = docs.select(F.struct(*own).alias("__row"), F.array().cast("array<long>").alias("__runs"), F.array().cast("array<string>").alias("__items"))
    held, size = [], 0
    for words, block in _item_blocks(benchmark, item_id, item_text, block_words):
        if held and size + words > worker_words:  # a round: what it found goes on with the rows, its blocks go
            found = rows.select("__row", _scanner(held, True, False)(text, "__runs", "__items").alias("__scan"))
            rows = checkpointed(found.select("__row", F.col("__scan.runs").alias("__runs"), F.col("__scan.items").alias("__items")))
            for index in held:
                index.unpersist()
            held, size = [], 0
        held.append(sc.broadcast(WindowIndex(block, n)))
        size += words

    found = rows.select("__row", _scanner(held, False, clean_text)(text, "__runs", "__items").alias("__scan"))
    names = ["n_words", "n_hit", "items", *["clean_text"] * clean_text]
    taken = {(prefix + c).lower() for c in [*names, "contaminated"]}
    hit, words = F.col("__scan.n_hit"), F.col("__scan.n_words")
    return found.select(
        *[F.col("__row").getField(c).alias(c) for c in docs.columns if c.lower() not in taken],
        *[F.col(f"__scan.{c}").alias(prefix + c) for c in names],
        ((hit > 0) & (20 * hit >= words)).alias(prefix + "contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns; repeated rows all stay."""
    marked = decontaminate(docs, benchmark, prefix="__")
    return marked.where("not __contaminated").select(*[F.col(f"`{c}`") for c in docs.columns])
