"""BPE, decontamination, toxicity, quality, sharding and archives."""

import base64
import hashlib
import io
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from data import contamination, docs_df, hostile_rows, multiset
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from punchspark.llm import bpe, quality, toxicity, warc
from punchspark.llm.decontaminate import decontaminate, drop_contaminated
from punchspark.llm.sharding import ring, shard, walk

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_bpe_and_decoding(spark):
    library = Tokenizer.from_file(PATH)
    rows = hostile_rows() + [(200, "a<|endoftext|>b " * 40), (201, "<|endoftext|>"), (202, "y" * 3000 + "<|endoftext|>" + "'" * 99)]
    want = [(i, library.encode(t or "", add_special_tokens=False).ids, t is None) for i, t in rows]
    got = bpe.encode(docs_df(spark, rows), PATH, leaf_chars=97).collect()
    assert multiset((r.id, list(r.ids), r.was_null) for r in got) == multiset(want)
    assert all(r.decoded == library.decode(list(r.ids), skip_special_tokens=False) for r in got)
    digests = bpe.encode(docs_df(spark, rows), PATH, digest=True).collect()
    assert Counter(r.ids_sha256 for r in digests) == Counter(hashlib.sha256(",".join(map(str, w[1])).encode()).hexdigest() for w in want)
    back = bpe.decode(spark.createDataFrame([(1, [15496, 50256]), (2, None)], "k int, ids array<int>"), PATH)
    assert {r.k: r.decoded for r in back.collect()} == {1: "Hello<|endoftext|>", 2: None}


def test_tree_of_leaves_equals_the_library():
    c, library, rng = bpe.coder(PATH), Tokenizer.from_file(PATH), random.Random(5)
    parts = ["a", "b", " ", "  ", "\n", "'s", "'re", "1", "23", "!", "é", "日本", "the ", "'", "l", "　", "x" * 30, "🙂"]
    for _ in range(400):
        text = "".join(rng.choices(parts[: rng.randint(1, len(parts))], k=rng.randint(1, 60)))
        leaf = rng.randint(1, 12)
        nodes = [c.leaf(text[k : k + leaf]) for k in range(0, len(text), leaf)]
        assert c.tree(nodes).ids == library.encode(text, add_special_tokens=False).ids


def test_decontamination(spark):
    rows = hostile_rows()
    by_id = dict(rows)
    items = [(1, by_id[40][100:400]), (2, "One two"), (3, None), (4, "!!"), (10, by_id[60].upper()), (10, "日本"), (None, "the")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = [(*w[:3], [i for i in w[3] if i != "None"]) for w in contamination(rows, items)]
    for block, worker in ((500_000, 500_000), (5, 500_000), (5, 20)):  # one block, many of them, several rounds
        docs = docs_df(spark, rows).withColumn("N_hit", F.lit("a column of the input"))
        got = decontaminate(docs, bench, block_words=block, worker_words=worker, clean_text=True).collect()
        assert "N_hit" not in got[0].asDict()
        assert multiset((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got) == multiset(want)
    assert all(r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in got)
    assert {r.clean_text for r in got if r.doc_id == 3} == {""}
    again = decontaminate(spark.createDataFrame([(1, r.clean_text) for r in got if r.doc_id in (60, 80)], "doc_id long, text string"), bench)
    assert again.where("n_hit >= 13").count() == 0
    kept = drop_contaminated(docs_df(spark, rows), bench)
    assert kept.columns == docs_df(spark, rows).columns and kept.count() == sum(not r.contaminated for r in got)
    assert drop_contaminated(docs_df(spark, []), bench).count() == 0
    assert drop_contaminated(docs_df(spark, rows), bench.limit(0)).count() == len(rows)


def test_items_without_an_id_hit_too(spark, tmp_path):
    from punchspark.llm.queries import ORACLES, op10_decontamination

    rows = hostile_rows()
    items = [(1, dict(rows)[40][100:400]), (None, dict(rows)[60]), (None, "the"), (None, None), (None, "!!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = [(*w[:3], [i for i in w[3] if i != "None"]) for w in contamination(rows, items)]
    got = decontaminate(docs_df(spark, rows), bench).collect()
    assert multiset((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got) == multiset(want)
    dropped = sum(hit > 0 and 20 * hit >= n for _, n, hit, _ in want)
    assert drop_contaminated(docs_df(spark, rows), bench).count() == len(rows) - dropped < len(rows)

    import duckdb

    spark.createDataFrame([(i, t) for i, t in dict(rows).items() if i is not None], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = op10_decontamination(spark, str(tmp_path))
    oracle = con.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLES['op10_decontamination']})").fetchall()
    assert multiset(map(tuple, df.collect())) == multiset(oracle)


def test_toxicity_finds_planted_words(spark):
    rng = random.Random(2)
    plain = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(200)]
    docs, labels = [], []
    for k in range(600):
        words = rng.choices(plain, k=40)
        if k % 5 == 0:
            words[7], words[20] = rng.choice(["zorgling", "vexnard"]), rng.choice(["zorgling", "vexnard"])
        docs.append((k, " ".join(words)))
        labels.append((k, int(k % 5 == 0)))
    docs += [(1000, None), (1001, ""), (1002, "ab " * 5000 + "zorgling"), (None, "zorgling vexnard"), (None, "zorgling vexnard")]
    df = docs_df(spark, docs)
    field = toxicity.train(df, spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int"))
    got = toxicity.tag(df, field).withColumn("held", toxicity.held_out()).collect()
    assert [r.doc_id for r in got] == [d[0] for d in docs]
    for r in got:
        toxic = r.text is not None and ("zorgling" in r.text or "vexnard" in r.text)
        assert (r.toxicity.score >= toxicity.THRESHOLD) == toxic, (r.doc_id, r.toxicity.score)
        assert [r.text[s.start : s.end] for s in r.toxicity.spans] == [m for m in (r.text or "").split() if m in ("zorgling", "vexnard")] or r.doc_id is None
        assert r.held == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    none = toxicity.train(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.toxicity.score for r in toxicity.tag(df, none).collect()} == {0.0}


def test_marginals_equal_enumeration():
    field, rng = toxicity.Field(), np.random.default_rng(1)
    field.transition = rng.normal(size=(2, 2))
    e, bounds = rng.normal(size=9), np.array([0, 4, 4, 9])
    p = field.marginals(e, bounds)
    for a, b in ((0, 4), (4, 9)):
        n = b - a
        states = (np.arange(2**n)[:, None] >> np.arange(n)) & 1
        energy = states @ e[a:b] + field.transition[states[:, :-1], states[:, 1:]].sum(axis=1)
        weight = np.exp(energy)
        assert np.allclose(p[a:b], (weight[:, None] * states).sum(axis=0) / weight.sum())


def test_quality_views(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for k in range(800):
        words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(30)]
        bad = k % 4 == 0
        docs.append((k, (" ### " if bad else " ").join(words), "en", "bad" if bad and k % 8 else "good", 180))
        if k < 500:
            labels.append((k, int(not bad)))
    docs += [(900, None, None, None, None), (901, "", "", "", 0), (None, "ab cd", "xx", None, -1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("x"))
    views = quality.train(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = quality.classify(df, views).collect()
    assert len(got) == len(docs)
    assert all(r.quality.kept == (r.doc_id % 4 != 0) for r in got if r.doc_id is not None and r.doc_id < 800)
    none = spark.createDataFrame([], "doc_id long, quality int")
    kept = quality.drop_rejected(df, none)
    assert kept.columns == df.columns and kept.count() == len(docs)


def test_views_exchange_labels_over_all_unlabelled_documents(spark):
    """Metadata that is never sure of a class still gives labels, and the pool has no bound."""
    rng = random.Random(9)
    docs, labels = [], []
    for k in range(9000):
        bad = k % 4 == 0
        source = "a" if rng.random() < (0.4 if bad else 0.6) else "b"
        docs.append((k, (" ### " if bad else " ").join(rng.choices(["ab", "cd", "efg", "h"], k=12)), "en", source, 40))
        if k < 400:
            labels.append((k, int(not bad)))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    views = quality.train(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert views.pool == sum(zlib.crc32(str(k).encode()) % 4 != 2 for k in range(400, 9000)) > 6000
    assert len(views.given) == quality.ROUNDS
    assert all(r[view, 1] >= 250 and r[view, 0] >= 80 for r in views.given for view in (0, 1))
    got = quality.classify(df, views).collect()
    assert all(r.quality.kept == (r.doc_id % 4 != 0) for r in got)


def test_sharding(spark):
    rows = hostile_rows() + [(k, "same") for k in range(1000, 1400)]
    got = shard(docs_df(spark, rows), shards=7, vnodes=16).collect()
    sizes = Counter(r.shard for r in got)
    assert sum(sizes.values()) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 7
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in sizes.items())
    assert multiset((r.doc_id, r["size"], r.text_crc32) for r in got) == multiset((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert shard(docs_df(spark, [])).count() == 0
    again = {(r.doc_id, r.shard, r.slot) for r in shard(docs_df(spark, rows).repartition(5), shards=7, vnodes=16).collect() if r.doc_id and r.doc_id >= 1000}
    assert again == {(r.doc_id, r.shard, r.slot) for r in got if r.doc_id and r.doc_id >= 1000}


def test_one_id_of_most_rows_is_spread(spark):
    rows = [(None, "x")] * 900 + [(5, "y")] * 900 + [(k, "z") for k in range(300)]
    docs = docs_df(spark, rows).repartition(6)
    got = shard(docs, shards=7, vnodes=16).collect()
    sizes = Counter(r.shard for r in got)
    assert sum(sizes.values()) == len(rows) and set(sizes.values()) == {300}
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(300)) for s in sizes)
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)

    from punchspark.operators.ordering import PART, range_sorted

    parts = [r[0] for r in range_sorted(docs.select("doc_id"), [F.col("doc_id")], 8).groupBy(PART).count().select("count").collect()]
    assert len(parts) == 8 and max(parts) < 450  # a third of the rows and more share an id, no task holds them


def test_labelled_sample_takes_one_row_for_an_id(spark):
    docs = docs_df(spark, [(k, "b") for k in range(40)] + [(k, "a") for k in range(40)] * 50)
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    got = toxicity.labelled_sample(docs, labels, "toxic", 10, ["doc_id", "text"]).collect()
    assert len(got) == len({r.doc_id for r in got}) == 10 and {r.text for r in got} == {"a"}


def test_walk_moves_few_rows():
    nodes = ring(10, 64)
    loads = {a: 10 for a in range(len(nodes))}
    segments = walk(nodes, loads, 10)
    home = sum(e - s for a, s, e, shard_, _ in segments if nodes[a][1] == shard_)
    assert home >= 0.8 * 10 * len(nodes)


PAGES = "page_id long, url string, html string, payload string, record_id string"


def _pages():
    rows = [(k, f"http://h/{k % 5} x", f"<p>page {k % 7}</p>") for k in range(60)]
    rows += [(100, None, None), (101, "", ""), (102, "u", "a\n\nWARC/1.0\r\nWARC-Type: x\r\n\r\nhttp://x 0 0 t 3\n\x00é" * 50), (None, "u", "<p>page 0</p>"), (103, "u", "long " * 200_000)]
    return rows


def test_archives_round_trip(spark, tmp_path):
    rows = _pages()
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES).repartition(3)
    got = warc.archive(pages, f"file://{tmp_path}/a").collect()
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    assert len(got) == len(rows)
    for r in got:
        html = next(h or "" for i, _, h in rows if i == r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), base64.b32encode(hashlib.sha1(html.encode()).digest()).decode())
        own = r.page_id == best[html]
        assert (r.record_type, r.refers_to) == (("response", None) if own else ("revisit", best[html]))
        assert (bytes(r.payload).decode() if r.payload is not None else None) == (html if own else None)
    assert len({r.record_id for r in got}) == len(rows)
    assert warc.archive(pages.limit(0), f"file://{tmp_path}/b").count() == 0


def test_arc_versions_are_read_by_their_own_header_lines():
    body = {v: f"{v} 0 o\n{warc.ARC_FIELDS[v]}\n".encode() for v in (1, 2)}
    data = b"filedesc://a 0.0.0.0 20240101000000 text/plain %d\n" % len(body[1]) + body[1] + b"\n"
    data += b"http://a 1.2.3.4 19991231235959 text/html 5\nab\ncd\n"
    data += b"filedesc://b 0.0.0.0 20240101000000 text/plain 200 - - 0 b %d\n" % len(body[2]) + body[2] + b"\n"
    data += b"http://b 1.2.3.4 20000101000000 text/html 404 sum - 7 b 0\n\n"
    got = list(warc.arc_records(io.BytesIO(data)))
    assert [(h["URL"], h.get("Result-code"), c) for h, c in got] == [("http://a", None, b"ab\ncd"), ("http://b", "404", b"")]
    with pytest.raises(ValueError):
        list(warc.arc_records(io.BytesIO(data[:-80])))
    with pytest.raises(ValueError):
        list(warc.arc_records(io.BytesIO(b"http://a 1.2.3.4 19991231235959 text/html 2\nab\n")))


def test_word_table_keeps_utf8():
    from punchspark.llm.common import mapped_words
    from punchspark.llm.decontaminate import WORD_TABLE

    words, bounds = mapped_words(pa.array([" Ab-c", None, "日本!é", ""]), WORD_TABLE)
    assert words.to_pylist() == ["ab", "c", "日本", "é"] and bounds.tolist() == [0, 2, 2, 4, 4]
