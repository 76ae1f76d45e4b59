"""Importance resampling, prefix trie and language model against brute force on hostile rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from punchspark.llm import importance as I
from punchspark.llm import language_model as M
from punchspark.llm import prefix_trie as T
from data import LOWER_AZ, bench_words, docs_df, hostile_rows, multiset

ITEMS = [(1, "the of x1 Über"), (2, None), (None, "naïve 日本 the of"), (4, "")]


def weights(rows, items, buckets):
    """(features, weight) of each row."""
    def cells(text):
        w = bench_words(text)
        grams = w + [f"{a} {b}" for a, b in zip(w, w[1:])]
        return [zlib.crc32(g.encode()) % buckets for g in grams]

    own = [cells(t) for _, t in rows]
    s, t = Counter(c for x in own for c in x), Counter(c for _, x in items for c in cells(x))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    return [(len(x), sum(gain[c] for c in x) // len(x) if x else 0) for x in own]


def noise(i):
    h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


@pytest.mark.parametrize("buckets", [10_000, 37])
def test_resampling(spark, buckets):
    rows = hostile_rows()
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = I.resample(docs_df(spark, rows), items, buckets=buckets).collect()
    want = [(i, len(bench_words(t)), n, w, w + noise(i)) for (i, t), (n, w) in zip(rows, weights(rows, ITEMS, buckets))]
    assert multiset((r.id, r.n_words, r.n_features, r.weight, r.score) for r in got) == multiset(want)
    able = sorted((x for x in want if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    drawn = sorted((r for r in got if r.rank), key=lambda r: r.rank)
    assert [r.rank for r in drawn] == list(range(1, 25 * len(able) // 100 + 1))
    assert [(r.id, r.score) for r in drawn] == [(x[0], x[4]) for x in able[: len(drawn)]]
    assert {r.doc_id for r in I.drawn_documents(docs_df(spark, rows), items, buckets=buckets).collect()} == {r.id for r in drawn}


def test_overlapped_spans():
    text = I.collapse("  A--b\n\tC'd é…E ")
    assert text == b"a b c d " + "é…e".encode()
    assert [m.group() for m in I.span_pattern(2).finditer(text, overlapped=True)] == [b"a b", b"b c", b"c d", b"d " + "é…e".encode()]
    assert [m.group() for m in I.span_pattern(3).finditer(b"aa b cc d", overlapped=True)] == [b"aa b cc", b"b cc d"]
    assert list(I.span_pattern(2).finditer(b"one", overlapped=True)) == [] and I.collapse(None) == I.collapse(" .,") == b""


def test_resampling_of_nothing(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert I.resample(docs_df(spark, []), items).count() == 0
    (r,) = I.resample(docs_df(spark, [(None, None)]), items.where("item_id = 9")).collect()
    assert (r.n_features, r.weight, r.rank) == (0, 0, None)


def conversations(spark):
    """Copies, prefixes, missing bases, null cells, ties of turn, repeated rows, and one conversation with a third of all rows."""
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 60), *range(101, 104), -7]:
        shared = [("user", "hi"), ("assistant", "hello"), (None, "Ω"), ("user", None)]
        for k in range(rng.randint(1, 12)):
            role, text = shared[k] if k < 4 and c % 3 else (rng.choice(["user", "assistant"]), f"t{rng.randint(0, 1)}")
            rows.append((c, rng.choice([k, k, None]) if c == 17 else k, role, text))
    rows += [(200, k, "user", f"long {k % 3}") for k in range(300)] + [(205, k, "user", f"long {k % 3}") for k in range(300)]
    rows += [(None, 0, "user", "lost"), (55, 3, "user", "tie"), (55, 3, "user", "tie"), (55, 3, "assistant", "tie")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, depth string, k1 int")
    return rows, df.repartition(5)


def trie_of(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            raw = f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()
            own[c].append((turn is not None, turn or 0, hashlib.sha256(raw).hexdigest(), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    seqs = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(math.fmod(c, 5))
        seqs[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c in sorted(seqs):
        for k in range(len(seqs[c]) + 1):
            members[seqs[c][:k]].append(c)
    parents = {n[:-1] for n in members if n}
    kids, leaves, saved = Counter(n[:-1] for n in members if n), Counter(), Counter()
    for n in members:
        gain = (len(members[n]) - 1) * len(n[-1][1].encode()) if n else 0
        for k in range(len(n) + 1):
            saved[n[:k]] += gain
            leaves[n[:k]] += n not in parents
    digest = lambda n: hashlib.sha256(",".join(str(c) for c in members[n] if len(seqs[c]) == len(n)).encode()).hexdigest()
    return [(members[n][0], len(n), members[n[:-1]][0] if n else None, len(members[n]), kids[n], leaves[n], saved[n], digest(n)) for n in members]


@pytest.mark.parametrize("piece", [4096, 2])
def test_prefix_trie(spark, monkeypatch, piece):
    monkeypatch.setattr(T, "PIECE", piece)
    rows, df = conversations(spark)
    rows += [(c, k, "user", "same") for c in range(300, 340) for k in range(9)]
    df = df.unionByName(spark.createDataFrame([(*r, "x", 1) for r in rows[-360:]], df.schema))
    trie = T.prefix_trie(df)
    got = [tuple(r)[:8] for r in trie.nodes.collect()]
    assert multiset(got) == multiset(trie_of(rows))
    assert max(len(r.conv_ids) for r in trie.ends.collect()) == min(piece, 40)


def test_prefix_trie_of_nothing(spark):
    _, df = conversations(spark)
    assert T.prefix_trie(df.where("conv_id = 999")).nodes.count() == 0
    assert T.prefix_trie(df.where("conv_id is null")).nodes.count() == 0


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER_AZ)) + ["\n"]


class KneserNey:
    """The textbook model, from lists of words."""

    def __init__(self, texts, order):
        grams = {k: Counter() for k in range(1, order + 1)}
        for t in texts:
            w = ["<s>", *words_of(t)]
            for k in range(2, order + 1):
                for s in range(len(w) - k + 1):
                    if k == order or s == 0:
                        grams[k][tuple(w[s : s + k])] += 1
        for k in range(order, 1, -1):
            for g in grams[k]:
                grams[k - 1][g[1:]] += 1
        self.order, self.grams = order, grams
        self.words = Counter(x for t in texts for x in words_of(t))
        self.d, self.contexts = {}, {}
        for k, own in grams.items():
            t = Counter(own.values())
            self.d[k] = M.discounts(np.array([t[1], t[2], t[3], t[4]]))
            of = self.contexts[k] = defaultdict(lambda: [0, 0, 0, 0])
            for g, c in own.items():
                of[g[:-1]][0] += c
                of[g[:-1]][min(c, 3)] += 1

    def p(self, context, word, k):
        if k == 0:
            return 1 / (len(self.words) + 1)
        if k > 1 and len(context) < k - 1:
            return self.p(context, word, k - 1)
        ctx = tuple(context[len(context) - k + 1 :]) if k > 1 else ()
        lower = self.p(context, word, k - 1)
        if ctx not in self.contexts[k]:
            return lower
        total, *n = self.contexts[k][ctx]
        c = self.grams[k][(*ctx, word)]
        return max(c - self.d[k][min(c, 3)], 0) / total + sum(x * y for x, y in zip(n, self.d[k][1:])) / total * lower

    def score(self, text):
        w = ["<s>", *words_of(text)]
        return sum(math.log10(self.p(w[:k], w[k], self.order)) for k in range(1, len(w)))


@pytest.mark.parametrize("order", [2, 3])
@pytest.mark.parametrize("flush", [1 << 21, 500])
def test_kneser_ney(spark, order, flush):
    rows = hostile_rows()
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    docs = docs_df(spark, rows).repartition(3)
    model = M.train(docs.where(~M.held_out()), order=order, flush_rows=flush, hot_share=100 if flush == 500 else M.HOT_SHARE)
    want = KneserNey([t for (_, t), h in zip(rows, held) if not h], order)
    got = {(r.id, r.n_tokens): r for r in M.score(docs, model).collect()}
    n, v = want.words.total(), len(want.words)
    for i, t in rows:
        w = words_of(t)
        r = got[i, len(w)]
        assert (r.n_known, r.train_tokens) == (sum(x in want.words for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((want.words[x] + 1) / (n + v + 1)) for x in w))
        assert r.score == pytest.approx(want.score(t)) and r.perplexity == pytest.approx(10 ** (-r.score / len(w)))
    assert len(M.score(docs, model).collect()) == len(rows)
    for context in (["<s>"], ["the"], ["<s>", "the"], ["of", "x1"], ["nowhere"]):  # a distribution, with the unknown word
        assert sum(want.p(context, x, order) for x in [*want.words, "unseen"]) == pytest.approx(1)


def test_kneser_ney_without_training(spark):
    docs = docs_df(spark, [(1, "a b"), (2, None)])
    got = {r.id: r for r in M.score(docs, M.train(docs.where("doc_id = 9"))).collect()}
    assert [(got[k].n_tokens, got[k].n_known, got[k].train_tokens, got[k].base_score, got[k].score) for k in (1, 2)] == [(3, 0, 0, 0, 0), (1, 0, 0, 0, 0)]
    assert M.score(docs.where("doc_id = 9"), M.train(docs)).count() == 0


def test_kneser_ney_needs_a_mounted_folder(spark, monkeypatch):
    monkeypatch.setattr(M, "ensure_checkpoint_dir", lambda spark: "hdfs://host/folder")
    with pytest.raises(ValueError, match="mounted"):
        M.train(docs_df(spark, [(1, "a")]))
    assert M.tokens(pa.array(["B c", None]))[1].tolist() == [0, 3, 4]
