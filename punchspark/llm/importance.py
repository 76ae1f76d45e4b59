"""Importance resampling towards a target distribution, over hashed n-grams of words.

Separators (ASCII other than letters and digits) collapse to single spaces and A-Z is
lower-cased, all by one byte table. On the collapsed text one pattern for each n finds all
runs of n words: ``regex.finditer`` with ``overlapped=True`` starts a match at every word,
lookarounds hold its ends to word boundaries, and the CRC-32 of the matched bytes is counted
in one of ``buckets`` buckets. So no list of words and no joined string is ever made.

Every text is scanned once: the buckets of its features (two bytes each) are checkpointed,
counted for the whole corpus, and then weighed. A bucket's gain is the log ratio of its
smoothed shares in target and corpus; a document's weight is the floored mean of its
features' gains; Gumbel noise from the document's id makes a draw without replacement of the
highest scores. Scores are ranked by range partitions (``dense_index``), never in one task.

Collected or broadcast: ``buckets`` counts and gains, whatever the tables hold.

Defined results: null and empty texts have no features, weight 0 and, like all documents of
fewer than ``least_words`` words, no rank. The id's decimal text seeds the noise (a null id: an
empty one), and null ids come last among equal scores. Repeated rows count as often as they
come, and repeated equal ids tie. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punchspark.llm.common import blocks, checkpointed
from punchspark.llm.decontaminate import WORD_TABLE
from punchspark.operators.roster import dense_index

BUCKETS = 10_000
MOST_WORDS = 2
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
GAIN = 1000
"""Gains and noise are whole thousandths of a natural logarithm."""
SCAN_BYTES = 1 << 20
CELL = np.dtype("<u2")


def span_pattern(n: int) -> regex.Pattern:
    """All runs of n words of a collapsed text, with overlapped matching."""
    return regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (n - 1))


def collapse(text: str | None) -> bytes:
    """Lower-cased words of the text with single spaces between them."""
    return b" ".join((text or "").encode().translate(WORD_TABLE).split())


def feature_buckets(words: bytes, patterns: list[regex.Pattern], buckets: int) -> np.ndarray:
    """The bucket of every feature of a collapsed text."""
    found = (crc32(m.group()) % buckets for p in patterns for m in p.finditer(words, overlapped=True))
    return np.fromiter(found, CELL)


def _scan(buckets: int, most_words: int):
    """(id, n_words, features): the text's words, and the buckets of its features as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [span_pattern(n) for n in range(1, most_words + 1)]
        for part in blocks(batches, "text", SCAN_BYTES):
            words, cells = [], []
            for value in part.column("text"):
                text = collapse(value.as_py())
                words.append(text.count(b" ") + 1 if text else 0)
                cells.append(feature_buckets(text, patterns, buckets).tobytes())
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(words, pa.int64()), pa.array(cells, pa.binary())], ["id", "n_words", "features"])

    return run


def scanned(docs: DataFrame, id_col: str, text_col: str, buckets: int, most_words: int) -> DataFrame:
    """(id, n_words, features) of each row."""
    if not 1 <= buckets <= 1 << 16:
        raise ValueError("buckets must fit two bytes")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = rows.select("id").schema.add("n_words", "long").add("features", "binary")
    return rows.mapInArrow(_scan(buckets, most_words), schema)


def bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """Features of all rows in each bucket. A task sends one number for a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for cells in batch.column("features"):
                total += np.bincount(np.frombuffer(cells.as_buffer(), CELL), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in rows.select("features").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(GAIN * ln(share in the target / share in the corpus)) of each bucket, both smoothed by one."""
    s, t, width = corpus.astype(float), target.astype(float), len(corpus)
    return np.floor(GAIN * np.log((t + 1) * (s.sum() + width) / ((s + 1) * (t.sum() + width)))).astype(np.int64)


def weighed(rows: DataFrame, gains: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight) of scanned rows."""
    shared = rows.sparkSession.sparkContext.broadcast(gains)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, weights = [], []
            for cells in batch.column("features"):
                own = np.frombuffer(cells.as_buffer(), CELL)
                sizes.append(len(own))
                weights.append(int(shared.value[own].sum()) // len(own) if len(own) else 0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_words"), pa.array(sizes, pa.int64()), pa.array(weights, pa.int64())], ["id", "n_words", "n_features", "weight"])

    schema = rows.select("id", "n_words").schema.add("n_features", "long").add("weight", "long")
    return rows.mapInArrow(run, schema)


def gumbel(id_col: Column, seed: int) -> Column:
    """floor of the thousandfold Gumbel noise of an id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(GAIN)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    buckets: int = BUCKETS,
    most_words: int = MOST_WORDS,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """One row per input row: id, n_words, n_features, weight, score, and rank (from 1) of the drawn ones.

    Drawn are floor(percent * N / 100) of the N documents of ``least_words`` words or more.
    """
    rows = checkpointed(scanned(docs, id_col, text_col, buckets, most_words))
    aims = scanned(target.select(F.lit(0).alias("id"), F.col(f"`{target_text}`").alias("text")), "id", "text", buckets, most_words)
    gains = bucket_gains(bucket_counts(rows, buckets), bucket_counts(aims, buckets))
    scored = weighed(rows, gains).withColumn("score", F.col("weight") + gumbel(F.col("id"), seed))
    able = F.col("n_words") >= least_words
    order = [F.desc(able.cast("int")), F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]
    placed = dense_index(scored.withColumn("row", F.monotonically_increasing_id()), order, "place", dtype="bigint")
    drawn = rows.where(able).count() * percent // 100
    return placed.select("id", "n_words", "n_features", "weight", "score", F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))


def drawn_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id is drawn, with all their columns; ids that repeat come whole if one of their rows is drawn."""
    drawn = resample(docs, target, id_col=id_col, text_col=text_col, **options).where("rank is not null").select(F.col("id").alias("__drawn")).distinct()
    return docs.join(drawn, F.col(f"`{id_col}`").eqNullSafe(F.col("__drawn")), "left_semi")
