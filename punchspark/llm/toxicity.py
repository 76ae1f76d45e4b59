"""Toxicity by a linear-chain conditional random field over words.

Training uses a bounded sample of labelled documents (``TRAIN_ROWS``, by the order of a hash
of the id; held-out ids never). Documents have labels, words have none, so words are labelled
first: words about as common in clean documents are set aside, and a greedy cover picks the
words and word beginnings that, one after the other, account for most toxic documents not
accounted for yet. What they match in toxic documents, with words and beginnings that tell
toxic documents still more clearly, are the labelled tokens. The field (two
states; features: the word, its first four and six and its last three characters, the words
beside it) is then fitted by its likelihood, with look-alikes of the labelled tokens among the
other tokens, and a two-feature logistic map from the marginals to the document label calibrates
the score.

Scoring runs over every word of every document: emissions come from one lookup per distinct
word of a block, forward and backward messages run in step over segments of ``SEGMENT`` words
with ``WARM`` words of run-in on either side, whose influence has died down by then (messages
contract at each step). Marginals give the score and the offending character spans.

Inputs of a score are the words of the text alone. Defined results: a null or empty text
scores like one without toxic words. Without labels of both kinds all scores are 0. Repeated
rows each get their row. A column ``toxicity`` of the input is replaced; other columns are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punchspark.llm.common import blocks, mapped_words
from punchspark.llm.decontaminate import WORD_PATTERN, WORD_TABLE
from punchspark.llm.near_dedup import word_hashes

TRAIN_ROWS = 4000
"""Labelled documents that the field is fitted on."""
TRAIN_TOKENS = 3000
"""Labelled tokens of these documents, and look-alikes, in whose windows it is fitted (and three plain tokens for each)."""
THRESHOLD = 0.3
SLOTS = 1 << 16
OWN_KINDS, KINDS = 4, 6
SEGMENT, WARM = 1024, 128
TAG_BYTES = 2 << 20
WINDOW = 8
SPAN_MARGINAL = 0.5
RATIO = 10
"""How much more often a toxic document must have a labelled word, or word beginning, than a clean one."""
BEGINNINGS = range(4, 9)
RATES = (0.4, 0.15, 0.3, 0.1, 0.02, 0.02)


def held_out(id_col: str = "doc_id") -> Column:
    """Ids whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, columns: list[str]) -> DataFrame:
    """At most ``rows`` labelled documents that aren't held out: ``columns`` and label, one row for an id (the least, if it repeats)."""
    own = labels.select(F.col("doc_id").alias("labelled_id"), F.col(label).cast("int").alias("label")).where("label is not null and labelled_id is not null")
    own = own.where(~held_out("labelled_id")).groupBy("labelled_id").agg(F.max("label").alias("label"))
    own = own.orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(rows)  # the documented bound of the sample
    found = docs.join(F.broadcast(own), F.col("doc_id") == F.col("labelled_id")).select("labelled_id", "label", F.struct(*columns).alias("row"))
    return found.groupBy("labelled_id", "label").agg(F.min("row").alias("row")).select("row.*", "label")


def _slots(words: pa.Array) -> np.ndarray:
    """(OWN_KINDS, words) slots of the features of the word alone."""
    parts = (words, pc.utf8_slice_codeunits(words, 0, 4), pc.utf8_slice_codeunits(words, 0, 6), pc.utf8_slice_codeunits(words, -3))
    return np.stack([(word_hashes(p) % np.uint64(SLOTS)).astype(np.int64) for p in parts])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


class Field:
    """Weights by feature kind and slot (log odds of the toxic state), transitions, and the calibration."""

    def __init__(self):
        self.weights = np.zeros((KINDS, SLOTS))
        self.bias = -4.0
        self.transition = np.zeros((2, 2))
        self.calibration = np.array([-20.0, 0.0, 0.0])
        self.trained = False

    def _step(self, x: np.ndarray) -> np.ndarray:
        """Log odds of the next state from those of this one."""
        t = self.transition
        return np.logaddexp(t[1, 1] + x, t[0, 1]) - np.logaddexp(t[1, 0] + x, t[0, 0])

    def _step_back(self, x: np.ndarray) -> np.ndarray:
        t = self.transition
        return np.logaddexp(t[1, 1] + x, t[1, 0]) - np.logaddexp(t[0, 1] + x, t[0, 0])

    def emissions(self, words: pa.Array, bounds: np.ndarray) -> np.ndarray:
        coded = words.dictionary_encode()
        ids = np.asarray(coded.indices).astype(np.int64)
        slots = _slots(coded.dictionary)
        own = self.bias + sum(self.weights[k][slots[k]] for k in range(OWN_KINDS))
        before, after = self.weights[OWN_KINDS][slots[0]][ids], self.weights[OWN_KINDS + 1][slots[0]][ids]
        e = own[ids]
        inner = np.ones(len(ids), bool)
        inner[bounds[:-1][bounds[:-1] < len(ids)]] = False  # no word before the first of a text
        at = np.flatnonzero(inner)
        e[at] += before[at - 1]
        e[at - 1] += after[at]
        return e

    def marginals(self, e: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Probability of the toxic state of each word."""
        core = [(s, min(s + SEGMENT, b), a, b) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()) for s in range(a, b, SEGMENT)]
        if not core:
            return np.zeros(0)
        lo, hi, first, last = np.array(core).T
        forward, back = np.empty(len(e)), np.empty(len(e))
        begin, end = np.maximum(lo - WARM, first), np.minimum(hi + WARM, last)

        def run(start: np.ndarray, stop: np.ndarray, keep_lo: np.ndarray, keep_hi: np.ndarray, sign: int, step, out: np.ndarray, closed: bool) -> None:
            """Messages from ``start`` in the direction ``sign``; those inside [keep_lo, keep_hi) are kept."""
            length = (stop - start) * sign
            order = np.argsort(-length, kind="stable")
            start, length, keep_lo, keep_hi = start[order], length[order], keep_lo[order], keep_hi[order]
            message = np.zeros(len(start))
            for t in range(int(length[0])):
                n = int(np.searchsorted(-length, -t, "left"))
                at = start[:n] + sign * t
                if t:
                    message = step(message[:n])
                if closed:
                    message = message + e[at]
                inside = (at >= keep_lo[:n]) & (at < keep_hi[:n])
                out[at[inside]] = message[inside]
                if not closed:
                    message = message + e[at]

        run(begin, hi, lo, hi, 1, self._step, forward, True)
        run(end - 1, lo - 1, lo, hi, -1, self._step_back, back, False)
        return _sigmoid(forward + back)

    def scores(self, p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.zeros(len(bounds) - 1)
        return _sigmoid(_aggregates(p, bounds) @ self.calibration)


def _aggregates(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per document: 1, the log odds of its most toxic word, and the log of the expected number of toxic words."""
    most, total = np.zeros(len(bounds) - 1), np.zeros(len(bounds) - 1)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        most[full] = np.maximum.reduceat(p, bounds[full])
        total[full] = np.add.reduceat(np.where(p > 0.05, p, 0), bounds[full])
    most = np.clip(most, 1e-4, 1 - 1e-4)
    return np.stack([np.ones(len(most)), np.log(most / (1 - most)), np.log1p(total)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        w -= np.linalg.solve(hessian, x.T @ (p - y) + penalty * w)
    return w


def _rates(pairs: np.ndarray, n: int, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the toxic and (smoothed) of the clean documents that have each of n things; pairs are distinct (row, thing)."""
    row, thing = pairs
    hot = np.bincount(thing[toxic[row]], minlength=n) / max(1, toxic.sum())
    return hot, (np.bincount(thing[~toxic[row]], minlength=n) + 0.5) / ((~toxic).sum() + 1)


def _distinct(row: np.ndarray, thing: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.unique(row * np.int64(n) + thing)
    return pairs // n, pairs % n


def covering_words(words: pa.Array, ids: np.ndarray, row: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Marks the words (of the vocabulary) that account for the toxic documents, by a greedy cover."""
    n = len(words)
    hot, clean = _rates(_distinct(row, ids, n), n, toxic)
    many = max(3, int((~toxic).sum()) // 200)  # enough clean documents to know a word by
    usual = (hot < RATIO * clean) & (clean * ((~toxic).sum() + 1) > many)
    words = words.cast(pa.string())
    forms = [words, *(pc.if_else(pc.greater_equal(pc.utf8_length(words), size), pc.utf8_slice_codeunits(words, 0, size), None) for size in BEGINNINGS)]
    parts = [pc.binary_join_element_wise(f, str(k), "/") for k, f in enumerate(forms)]
    coded = pa.concat_arrays(parts).dictionary_encode()
    things = np.asarray(pc.fill_null(coded.indices, -1)).astype(np.int64).reshape(len(parts), n)
    m = len(coded.dictionary)
    keep = ~usual[ids]
    own = things[:, ids[keep]]
    rows = np.broadcast_to(row[keep], own.shape)
    rows, thing = _distinct(rows[own >= 0], own[own >= 0], m)
    hot, clean = _rates((rows, thing), m, toxic)
    able = hot >= RATIO * clean
    inside = toxic[rows] & able[thing]
    rows, thing = rows[inside], thing[inside]
    left, chosen, floor = toxic.copy(), [], max(3, int(toxic.sum()) // 50)
    while len(thing):
        gain = np.bincount(thing[left[rows]], minlength=m)
        best = int(gain.argmax())
        if gain[best] < floor:
            break
        chosen.append(best)
        left[rows[thing == best]] = False
    strong = (hot >= 3 * RATIO * clean) & (hot * toxic.sum() >= floor)
    return (np.isin(things, chosen) | strong[things] & (things >= 0)).any(axis=0) & ~usual


def fit(texts: list[str | None], labels: list[int], seed: int = 7, rounds: int = 60, tokens: int = TRAIN_TOKENS) -> Field:
    """The field of a labelled sample."""
    field, toxic = Field(), np.array(labels, bool)
    if not toxic.any() or toxic.all():
        return field
    words, bounds = mapped_words(pa.array(texts, pa.large_string()), WORD_TABLE)
    coded = words.dictionary_encode()
    ids = np.asarray(coded.indices).astype(np.int64)
    row = np.repeat(np.arange(len(toxic)), np.diff(bounds))
    chosen = covering_words(coded.dictionary, ids, row, toxic)
    target = chosen[ids] & toxic[row]
    if not target.any():
        return field
    slots = _slots(coded.dictionary)
    alike = np.isin(slots[1], slots[1][chosen])[ids] & ~target
    rng = np.random.default_rng(seed)
    marked = np.flatnonzero(target)
    marked = rng.permutation(marked)[:tokens]
    plain = rng.choice(len(ids), min(3 * len(marked), len(ids)), replace=False)
    centre = np.concatenate([marked, rng.permutation(np.flatnonzero(alike))[:tokens], plain])
    shift = rng.integers(-WINDOW // 2, WINDOW // 2 + 1, len(centre))
    grid = (centre + shift)[:, None] + np.arange(-WINDOW, WINDOW + 1)[None, :]
    own_row = row[centre]
    inside = (grid >= bounds[own_row][:, None]) & (grid < bounds[own_row + 1][:, None])
    safe = np.clip(grid, 0, len(ids) - 1)
    beside = np.concatenate([[-1], ids[:-1]]), np.concatenate([ids[1:], [-1]])
    y = target[safe] & inside
    feats = [slots[k][ids[safe]] for k in range(OWN_KINDS)]
    for side, off in zip(beside, (-1, 1)):
        ok = inside & (grid + off >= bounds[own_row][:, None]) & (grid + off < bounds[own_row + 1][:, None])
        feats.append(np.where(ok, slots[0][side[safe]], -1))
    n, width = grid.shape
    total = inside.sum()
    pair = inside[:, 1:] & inside[:, :-1]
    squares, t_squares, b_square = np.full((KINDS, SLOTS), 1e-12), np.full((2, 2), 1e-12), 1e-12
    for _ in range(rounds):
        e = np.full((n, width), field.bias)
        for k in range(KINDS):
            e += np.where(feats[k] >= 0, field.weights[k][feats[k]], 0)
        a = np.zeros((n, width))
        b = np.zeros((n, width))
        for t in range(width):
            a[:, t] = e[:, t] + (np.where(pair[:, t - 1], field._step(a[:, t - 1]), 0) if t else 0)
        for t in range(width - 2, -1, -1):
            b[:, t] = np.where(pair[:, t], field._step_back(b[:, t + 1] + e[:, t + 1]), 0)
        p = _sigmoid(a + b)
        slope = np.where(inside, y - p, 0) / total
        # expected transitions against those seen
        joint = np.zeros((2, 2, *pair.shape))
        for i in range(2):
            for j in range(2):
                joint[i, j] = i * a[:, :-1] + field.transition[i, j] + j * (e[:, 1:] + b[:, 1:])
        joint = np.exp(joint - joint.max(axis=(0, 1)))
        joint /= joint.sum(axis=(0, 1))
        seen = np.array([[((y[:, :-1] == i) & (y[:, 1:] == j) & pair).sum() for j in range(2)] for i in range(2)])
        t_slope = (seen - (joint * pair).sum(axis=(2, 3))) / total - 1e-3 * field.transition / 10
        t_squares += t_slope**2
        field.transition += 0.2 * t_slope / np.sqrt(t_squares)
        for k in range(KINDS):
            ok = feats[k] >= 0
            g = np.bincount(feats[k][ok], slope[ok], SLOTS) - 2e-7 * field.weights[k]
            squares[k] += g**2
            field.weights[k] += RATES[k] * g / np.sqrt(squares[k])
        g = slope.sum()
        b_square += g**2
        field.bias += 0.3 * g / np.sqrt(b_square)
    field.trained = True
    p = field.marginals(field.emissions(words, bounds), bounds)
    field.calibration = _logistic(_aggregates(p, bounds), toxic.astype(float))
    return field


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Field:
    """The field fitted on a sample of at most ``rows`` labelled documents, which come to the driver."""
    sample = labelled_sample(docs.select("doc_id", "text"), labels, "toxic", rows, ["doc_id", "text"]).collect()
    sample.sort(key=lambda r: (r.doc_id, r.text or ""))
    return fit([r.text for r in sample], [r.label for r in sample])


def tag(docs: DataFrame, field: Field, text_col: str = "text", with_spans: bool = True) -> DataFrame:
    """``docs`` with a struct column toxicity: score, n_words, expected (toxic words), spans (start, end characters)."""
    shared = docs.sparkSession.sparkContext.broadcast(field)  # KINDS * SLOTS weights, whatever the corpus

    @F.pandas_udf("score double, n_words long, expected double, spans array<struct<start:int,end:int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            whole = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string(), from_pandas=True)], ["text"])
            parts = []
            for part in blocks(iter([whole]), "text", TAG_BYTES):
                words, bounds = mapped_words(part.column("text"), WORD_TABLE)
                p = shared.value.marginals(shared.value.emissions(words, bounds), bounds)
                total = np.concatenate([[0], np.cumsum(p)])
                spans: list[list] = [[] for _ in range(part.num_rows)]
                if with_spans:
                    hot = np.flatnonzero(p > SPAN_MARGINAL)
                    rows = np.searchsorted(bounds, hot, "right") - 1
                    for row in np.unique(rows).tolist():
                        spans[row] = _spans(part.column("text")[row].as_py(), hot[rows == row] - bounds[row])
                parts.append(pd.DataFrame({"score": shared.value.scores(p, bounds), "n_words": np.diff(bounds), "expected": total[bounds[1:]] - total[bounds[:-1]], "spans": spans}))
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"score": pd.Series(dtype=float), "n_words": pd.Series(dtype="int64"), "expected": pd.Series(dtype=float), "spans": pd.Series(dtype=object)})

    return docs.withColumn("toxicity", run(F.col(f"`{text_col}`").cast("string")))


def _spans(text: str, words: np.ndarray) -> list[dict[str, int]]:
    """Character spans of the words with these numbers; neighbours are one span."""
    wanted, out, last = set(words.tolist()), [], -2
    for k, m in enumerate(WORD_PATTERN.finditer(text)):
        if k in wanted:
            if k == last + 1:
                out[-1]["end"] = m.end()
            else:
                out.append({"start": m.start(), "end": m.end()})
            last = k
    return out
