"""Quality classifier by co-training of two views.

The text view sees the content (byte frequencies, word and line statistics), the metadata view
sees lang, source and n_chars. Both are logistic regressions fitted on a bounded sample of
labelled documents (``LABELLED_ROWS``); all unlabelled documents carry the exchange: in each of
``ROUNDS`` rounds every view scores the whole pool in Spark and labels the documents that it is
most sure of, by rank and per class (in the shares of the labelled classes), and the other view
learns from them, with the giving view's probability as the label: a view that is surest of a
class at 0.4 says so, and doesn't pass a guess on as a fact. Features are made once and checkpointed; of the pool, only the chosen rows come
to the driver. At most half of a small pool is labelled by a view. A part of the labelled sample is kept
from the fits: on it each view is calibrated (Platt scaling) and the combination of the two
calibrated views is fitted. Then all documents are scored.

Held-out ids and null ids (see ``toxicity.held_out``) are never learned from. Defined results: a null or
empty text has zero frequencies, null metadata are values of their own. Without labels of both
kinds every document scores 1 and is kept. Repeated rows each get their row. A column
``quality`` of the input is replaced; other columns are passed through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from punchspark.llm.common import LOWER, blocks, checkpointed, mapped_words, text_bytes
from punchspark.llm.near_dedup import word_hashes
from punchspark.llm.toxicity import _logistic, _sigmoid, held_out, labelled_sample

LABELLED_ROWS = 6000
"""Labelled documents that the classifiers are fitted on."""
ROUNDS, PER_ROUND = 4, 200
"""Rounds of the exchange, and labels a class that each view gives in one, on the average of both classes."""
KEEP_SCORE = 0.3
META_SLOTS = 64
VIEW_BYTES, VIEW_ROWS = 1 << 20, 512
"""Bytes and rows of text whose features are made at a time; both take many times that in memory."""


def text_view(texts: pa.Array) -> np.ndarray:
    """Content features, one row per text."""
    data, offsets = text_bytes(texts)
    n, sizes = len(offsets) - 1, np.diff(offsets)
    row = np.repeat(np.arange(n), sizes)
    kind = np.minimum(data, 128).astype(np.int64)
    counts = np.bincount(row * 129 + kind, minlength=n * 129).reshape(n, 129)
    shares = np.sqrt(counts / np.maximum(sizes, 1)[:, None])
    words, bounds = mapped_words(texts, LOWER)
    lengths = np.diff(bounds)
    letters = sizes - counts[:, 32] - counts[:, 10]
    distinct = np.zeros(n)
    if len(words):
        owner = np.repeat(np.arange(n), lengths)
        order = np.lexsort((h := word_hashes(words), owner))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        distinct = np.bincount(owner[order][fresh], minlength=n)
    stats = np.stack([letters / np.maximum(lengths, 1) / 10, distinct / np.maximum(lengths, 1), counts[:, 10] / np.maximum(lengths, 1), np.log1p(lengths) / 10], axis=1)
    return np.concatenate([np.ones((n, 1)), shares, stats], axis=1)


def meta_view(lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> np.ndarray:
    """Metadata features, one row per document."""
    n = len(lang)
    out = np.zeros((n, 2 * META_SLOTS + 26))
    out[:, 0] = 1
    rows = np.arange(n)
    for k, column in enumerate((lang, source)):
        names = pa.array([f"={v}" for v in column.to_pylist()], pa.string())
        if n:
            out[rows, 1 + k * META_SLOTS + (word_hashes(names) % np.uint64(META_SLOTS - 1)).astype(np.int64)] = 1
    size = np.array([-1 if v is None else v for v in n_chars.to_pylist()], float)
    band = np.where(size < 0, 0, 1 + np.minimum(np.log2(np.maximum(size, 0) + 1), 23)).astype(np.int64)
    out[rows, 2 * META_SLOTS + 1 + band] = 1
    return out


class Views:
    """Weights and calibration of both views and of their combination."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, calibration: list[np.ndarray], combined: np.ndarray):
        self.weights, self.calibration, self.combined = (text, meta), calibration, combined
        self.pool, self.given = 0, []

    def logits(self, views: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Calibrated log odds: 1, text, metadata."""
        raw = [v @ w for v, w in zip(views, self.weights)]
        return np.stack([np.ones(len(raw[0])), *(c[0] + c[1] * r for c, r in zip(self.calibration, raw))], axis=1)

    def scores(self, views: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """(rows, 3): text view, metadata view, combined."""
        x = self.logits(views)
        return _sigmoid(np.stack([x[:, 1], x[:, 2], x @ self.combined], axis=1))


def co_train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, surest: Callable, size: int, rounds: int = ROUNDS, per_round: int = PER_ROUND) -> Views:
    """Both views fitted with exchanged pseudo-labels; every fourth labelled row calibrates.

    ``surest(weights, counts, taken)`` finds, in a pool of ``size`` documents, {(view, label): (keys, rows of both views, probabilities of label 1)}.
    """
    rest = np.arange(len(y)) % 4 == 3
    known = [(v[~rest], y[~rest]) for v in views]
    weights = [_logistic(x, t) for x, t in known]
    total = min(2 * per_round, size // (2 * rounds))
    good = min(max(round(total * y.mean()), 1), total - 1)
    taken: set = set()
    history = []
    for _ in range(rounds if total > 1 else 0):
        found = surest(weights, {1: good, 0: total - good}, taken)
        history.append({name: len(keys) for name, (keys, *_) in found.items()})
        if not any(history[-1].values()):
            break
        for (k, _), (keys, rows, p) in found.items():
            x, t = known[1 - k]
            known[1 - k] = (np.concatenate([x, rows[1 - k]]), np.concatenate([t, p]))
            taken.update(keys)
        weights = [_logistic(x, t) for x, t in known]
    t = y[rest]
    calibration = [_logistic(np.stack([np.ones(rest.sum()), v[rest] @ w], axis=1), t, 0.01) for v, w in zip(views, weights)]
    done = Views(weights[0], weights[1], calibration, np.array([0.0, 1.0, 0.0]))
    done.pool, done.given = size, history
    done.combined = _logistic(done.logits(tuple(v[rest] for v in views)), t, 0.1)
    return done


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text features, and the places of the metadata features that are 1."""
    for part in blocks(batches, "text", VIEW_BYTES, VIEW_ROWS):
        text = text_view(part.column("text")).astype(np.float32)
        meta = meta_view(part.column("lang"), part.column("source"), part.column("n_chars"))
        places = np.nonzero(meta)[1].astype(np.int16).reshape(len(meta), -1)
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("label"), pa.array([r.tobytes() for r in text], pa.binary()), pa.array([r.tobytes() for r in places], pa.binary())],
            ["doc_id", "label", "text", "meta"],
        )


def _matrices(text: list[bytes], meta: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Both views of rows made by ``_features``."""
    n = len(text)
    if not n:
        return text_view(pa.array([], pa.string())), np.zeros((0, 2 * META_SLOTS + 26))
    dense = np.zeros((n, 2 * META_SLOTS + 26))
    places = np.frombuffer(b"".join(meta), np.int16).reshape(n, -1)
    dense[np.arange(n)[:, None], places] = 1
    return np.frombuffer(b"".join(text), np.float32).reshape(n, -1).astype(float), dense


def _ranked(weights: list[np.ndarray], counts: dict[int, int], taken: set):
    """The rows of a task that each view is surest of, per class: view, label, certainty, doc_id and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {(k, label): (np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)) for k in (0, 1) for label in (1, 0)}
        for batch in blocks(batches, "text", VIEW_BYTES, VIEW_ROWS):
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "key"))
            free = np.array([x not in taken for x in zip(ids.tolist(), keys.tolist())], bool)
            views = _matrices(batch.column("text").to_pylist(), batch.column("meta").to_pylist())
            for (k, label), held in best.items():
                sure = np.round((2 * label - 1) * (views[k] @ weights[k]), 9)[free]
                c, i, h = (np.concatenate(x) for x in zip(held, (sure, ids[free], keys[free])))
                order = np.lexsort((h, i, -c))
                new = np.ones(len(order), bool)  # repeated rows count once
                new[1:] = (i[order][1:] != i[order][:-1]) | (h[order][1:] != h[order][:-1])
                order = order[new][: counts[label]]
                best[k, label] = c[order], i[order], h[order]
        for (k, label), (c, i, h) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), k, np.int32)), pa.array(np.full(len(c), label, np.int32)), pa.array(c), pa.array(i), pa.array(h)], ["view", "label", "certainty", "doc_id", "key"])

    return run


def _surest(pool: DataFrame) -> Callable:
    """The ``surest`` of ``co_train`` over a pool of features in Spark: best rows of each task, then of all."""

    def find(weights: list[np.ndarray], counts: dict[int, int], taken: set) -> dict:
        ranked = pool.mapInArrow(_ranked(weights, counts, frozenset(taken)), "view int, label int, certainty double, doc_id long, key long")
        best = ranked
        for salts in (1 + int(pool.rdd.getNumPartitions() ** 0.5), 1):  # a tree: the best of each part, then of all
            part = F.pmod(F.xxhash64("doc_id", "key"), F.lit(salts))
            place = F.row_number().over(Window.partitionBy("view", "label", part).orderBy(F.desc("certainty"), "doc_id", "key"))
            best = best.withColumn("place", place).where((F.col("label") == 1) & (F.col("place") <= counts[1]) | (F.col("label") == 0) & (F.col("place") <= counts[0])).drop("place")
        best = best.collect()
        chosen = {(r.doc_id, r.key) for r in best}
        if not chosen:
            return {}
        wanted = pool.sparkSession.createDataFrame(sorted(chosen), "doc_id long, key long")
        rows = {(r.doc_id, r.key): r for r in pool.join(F.broadcast(wanted), ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).collect()}
        found = {}
        for name in ((k, label) for k in (0, 1) for label in (1, 0)):
            sure = {(r.doc_id, r.key): r.certainty for r in best if (r.view, r.label) == name}
            keys = sorted(sure)
            p = _sigmoid((2 * name[1] - 1) * np.array([sure[x] for x in keys], float))
            found[name] = keys, _matrices([rows[x].text for x in keys], [rows[x].meta for x in keys]), p
        return found

    return find


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", labelled_rows: int = LABELLED_ROWS) -> Views | None:
    """Views fitted on a bounded labelled sample, whose features (not texts) come to the driver, and on all unlabelled documents; None without both classes."""
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long"))
    made = "doc_id long, label int, text binary, meta binary"
    known = labelled_sample(own, labels, label, labelled_rows, COLUMNS).mapInArrow(_features, made).collect()
    known.sort(key=lambda r: (r.doc_id, r.text, r.meta))
    y = np.array([r.label for r in known], float)
    if len(set(y[np.arange(len(y)) % 4 != 3])) < 2 or len(set(y[np.arange(len(y)) % 4 == 3])) < 2:
        return None
    views = _matrices([r.text for r in known], [r.meta for r in known])
    free = own.where("doc_id is not null").where(~held_out()).withColumn("label", F.lit(-1)).mapInArrow(_features, made)
    free = free.join(labels.select(F.col("doc_id").cast("long")).distinct(), "doc_id", "left_anti")
    pool = checkpointed(free.select("doc_id", F.xxhash64("text", "meta").alias("key"), "text", "meta"))
    return co_train(views, y, _surest(pool), pool.count())


def classify(docs: DataFrame, views: Views | None) -> DataFrame:
    """``docs`` with a struct column quality: text_score, meta_score, score, kept."""
    if views is None:
        one = F.lit(1.0)
        return docs.withColumn("quality", F.struct(one.alias("text_score"), one.alias("meta_score"), one.alias("score"), F.lit(True).alias("kept")))
    shared = docs.sparkSession.sparkContext.broadcast(views)  # a fixed number of weights

    @F.arrow_udf("text_score double, meta_score double, score double")
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for arrays in batches:
            whole = pa.RecordBatch.from_arrays(list(arrays), ["text", "lang", "source", "n_chars"])
            parts = [shared.value.scores((text_view(p.column("text")), meta_view(*(p.column(c) for c in ("lang", "source", "n_chars"))))) for p in blocks(iter([whole]), "text", VIEW_BYTES, VIEW_ROWS)]
            scores = np.concatenate(parts) if parts else np.zeros((0, 3))
            yield pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(scores[:, k])) for k in range(3)], ["text_score", "meta_score", "score"])

    own = run(F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long"))
    scored = docs.withColumn("quality", own)
    return scored.withColumn("quality", F.col("quality").withField("kept", F.col("quality.score") >= KEEP_SCORE))


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns; repeated rows all stay."""
    names = docs.columns
    packed = docs.select(*COLUMNS, F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"))
    kept = classify(packed, train(docs, labels)).where("quality.kept")
    return kept.select(*[F.col("__row").getField(c).alias(c) for c in names])
