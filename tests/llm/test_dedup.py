"""Exact, near, line and substring dedup against brute force on hostile rows."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from data import docs_df, hostile_rows, multiset, near_components, near_set, substring_dedup

from punchspark.llm import near_dedup as N
from punchspark.llm import suffix_dedup as S
from punchspark.llm.components import components
from punchspark.llm.exact_dedup import drop_copies, exact_dedup
from punchspark.llm.line_dedup import SPACING, line_dedup
from punchspark.llm.near_dedup import BUCKETS, Scheme, _able, drop_near_copies, near_dedup, rarest, shingle_sets, signatures


def test_exact_dedup(spark):
    rows = hostile_rows()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i))
    want = []
    for i, t in rows:
        group = sorted(groups[norm(t)], key=lambda g: (g[0], g[1], g[2] or 0))
        want.append((i, group[0][2], len(group), hashlib.sha256(norm(t).encode()).hexdigest()))
    got = exact_dedup(docs_df(spark, rows)).collect()
    assert multiset((r.id, r.keep_id, r.group_size, r.text_sha256) for r in got) == multiset(want)
    assert sum(r.kept for r in got) == len(groups)
    kept = drop_copies(docs_df(spark, rows))
    assert kept.columns == docs_df(spark, rows).columns and kept.count() == len(groups)


def test_exact_dedup_group_over_many_partitions(spark):
    rows = [(k, " same  text " + " " * (k % 3)) for k in range(300)] + [(1000 + k, f"other {k}") for k in range(20)]
    got = exact_dedup(docs_df(spark, rows).repartition(7)).collect()
    assert {(r.keep_id, r.group_size) for r in got if r.id < 1000} == {(2, 300)}
    assert sum(r.kept for r in got) == 21


def test_near_dedup(spark):
    rows = hostile_rows()
    want = near_components(rows)
    got = near_dedup(docs_df(spark, rows)).collect()
    assert multiset((r.id, r.n_shingles, r.component_id) for r in got) == multiset((rows[k][0], *want[k]) for k in range(len(rows)))
    kept = drop_near_copies(docs_df(spark, rows))
    assert kept.columns == docs_df(spark, rows).columns
    named = {w[1] for r, w in zip(rows, want) if w[0] and w[1] is not None}
    assert {r.doc_id for r in kept.collect()} - {None, 0, 1, 2} == named


def test_one_row_of_a_component_stays_when_ids_repeat(spark):
    words = [f"w{k}" for k in range(300)]
    near = lambda p, k: " ".join([f"{p}{k}", *(p + w for w in words)])
    rows = [(7, near("a", k)) for k in range(4)] + [(8, near("a", 9)), (None, near("a", 10))]
    rows += [(None, near("b", k)) for k in range(4)] + [(7, near("c", k)) for k in range(3)] + [(7, near("c", 0))]
    got = drop_near_copies(docs_df(spark, rows)).collect()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    first = lambda p, n: min((near(p, k) for k in range(n)), key=digest)
    assert multiset((r.doc_id, r.text) for r in got) == multiset([(7, first("a", 4)), (None, first("b", 4)), (7, first("c", 3))])
    assert sum(r.kept for r in near_dedup(docs_df(spark, rows)).collect()) == 12


@pytest.mark.parametrize("percent", [60, 80, 95])
def test_near_dedup_at_other_similarities(spark, percent):
    """Copies with edits in rising numbers, so that pairs lie on both sides of every threshold."""
    words = [f"w{k}" for k in range(300)]
    rows = [(0, " ".join(words))]
    for k in range(1, 30):
        own = [f"x{k}" if j % 97 < k // 6 or j in range(k, k + 2) else w for j, w in enumerate(words)]
        rows += [(k, " ".join(own)), (100 + k, " ".join(own[: 300 - 3 * k]))]
    rows += hostile_rows()
    got = near_dedup(docs_df(spark, rows), percent=percent).collect()
    assert multiset((r.id, r.n_shingles, r.component_id) for r in got) == multiset((r[0], *w) for r, w in zip(rows, near_components(rows, percent)))


def test_scheme_misses_rarely():
    for percent in range(1, 100):
        s = Scheme(percent)
        assert (1 - (percent / 100) ** s.rows) ** s.bands <= 1.001e-6 and s.samples == s.bands * s.rows
    assert (Scheme(85).bands, Scheme(85).rows, Scheme(80).bands, Scheme(80).rows) == (24, 5, 27, 4)
    with pytest.raises(ValueError):
        Scheme(100)


def test_near_dedup_links_without_a_common_leader(spark):
    """Chains of edits: neighbours are links, ends are not."""
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(40):
        words = words.copy()
        words[(k * 37) % 400] = f"e{k}"
        words[(k * 91 + 5) % 400] = f"f{k}"
        rows.append((k, " ".join(words)))
    got = near_dedup(docs_df(spark, rows)).collect()
    assert {(r.id, r.component_id) for r in got} == {(rows[k][0], w[1]) for k, w in enumerate(near_components(rows))}


def test_near_dedup_of_a_template(spark):
    """Documents that share a template without being links meet through their own words alone; links among them are found."""
    frame = [f"t{j}" for j in range(150)]
    rows = [(k, " ".join(frame + [f"d{k}x{j}" for j in range(36)])) for k in range(150)]
    rows += [(1000 + k, rows[k][1] + f" end{k}") for k in range(0, 150, 7)]
    rows += [(2000 + k, rows[k][1].replace(f"d{k}x20", "other").replace("t75", "other")) for k in range(0, 150, 11)]
    got = near_dedup(docs_df(spark, rows).repartition(5)).collect()
    assert {(r.id, r.n_shingles, r.component_id) for r in got} == {(r[0], *w) for r, w in zip(rows, near_components(rows))}
    made = spark.range(100).selectExpr("id as doc_id", f"concat('{' '.join(frame)}', array_join(transform(sequence(0, 35), j -> concat(' d', id, 'x', j)), '')) as text")
    assert all(r.id == r.component_id for r in near_dedup(made).collect())


@pytest.mark.parametrize("percent", [50, 80, 85, 99])
def test_rarest_shingles_of_similar_sets_meet(percent):
    rng = np.random.default_rng(percent)
    counts = rng.integers(0, 5, BUCKETS)
    similar = 0
    for _ in range(10_000):
        both = rng.integers(0, 2**63, rng.integers(1, 60), dtype=np.uint64)
        x, y = (np.unique(np.concatenate([both, rng.integers(0, 2**63, rng.integers(0, 12), dtype=np.uint64)])) for _ in range(2))
        if 100 * len(np.intersect1d(x, y)) >= percent * len(np.union1d(x, y)):
            similar += 1
            assert len(np.intersect1d(rarest(x, counts, percent), rarest(y, counts, percent)))
    assert similar > 20


def test_pairs_of_one_set_are_confirmed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(N, "HUB_PAIRS", 3)
    test_near_dedup(spark)


@pytest.mark.parametrize("bits", [1 << 15, 1 << 20])
def test_filter_of_wanted_keys_loses_none(spark, monkeypatch, bits):
    """A table too small for its keys lets all through."""
    monkeypatch.setattr(N, "FILTER_BITS", bits)
    keys = spark.range(100_000).selectExpr("if(id = 0, null, id) as id", "sha2(string(id), 256) as sha")
    maybe = N._maybe_among(keys.where("id is null or id % 2 = 0"), "id", "sha")
    got = {r.id for r in keys.where(maybe("id", "sha")).select("id").collect()}
    assert got >= {None, *range(2, 100_000, 2)} and (bits == 1 << 15 or len(got) < 55_000)


def test_set_sketch_never_rules_out_a_link(spark):
    import pyarrow as pa

    texts = [t for _, t in hostile_rows() if near_set(t)]
    sets = shingle_sets(pa.array(texts))
    _, sketch = signatures(sets)
    rows = [(k, len(s), [int(x) for x in v.view(np.int64)]) for k, (s, v) in enumerate(zip(sets, sketch))]
    df = spark.createDataFrame(rows, "k int, n long, sketch array<long>")
    pairs = df.selectExpr("k as a", "n as n_a", "sketch as sketch_a").join(df.selectExpr("k as b", "n as n_b", "sketch as sketch_b"))
    able = {(r.a, r.b) for r in pairs.where("a < b").where(_able()).select("a", "b").collect()}
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            n = len(np.intersect1d(sets[a], sets[b]))
            if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
                assert (a, b) in able


def test_components_of_a_path(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 200), (200, 300), (5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {200: 100, 300: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(3)
    for _ in range(40):
        text = np.concatenate([rng.integers(0, rng.integers(1, 6) + 1, rng.integers(1, 300)), [0]]).astype(np.int16)
        order = S.suffix_array(text, 20)
        ends = np.flatnonzero(text == 0)
        keys = [tuple(text[i : min(ends[np.searchsorted(ends, i)], i + 20)].tolist()) for i in order.tolist()]
        assert sorted(order.tolist()) == list(range(len(text))) and keys == sorted(keys)


def test_suffix_dedup(spark):
    rows = hostile_rows()
    got = S.suffix_dedup(docs_df(spark, rows)).collect()
    assert multiset((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == multiset(substring_dedup(rows))
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got if r.kept is not None)


def crowded_rows():
    """A line of 70 bytes in most documents, amid text that differs, and some passages around it that repeat."""
    rng = np.random.default_rng(6)
    line = "shared header " * 5
    part = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n))
    rows = [(k, part(120) + line + part(120)) for k in range(1500)]
    for k in range(200):
        other = rows[int(rng.integers(1500))][1]
        rows.append((2000 + k, part(30) + other[90 - k % 60 : 190 + k % 60] + part(30)))
    return rows + [(5000, line), (5001, part(99) + line), (None, part(10) + rows[7][1])]


def test_contexts_of_a_crowded_gram_are_parted():
    import pyarrow as pa

    ids, texts = zip(*crowded_rows()[:-1])
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array([0] * len(ids)), pa.array(texts)], ["id", "tie", "text"])
    for pieces in ([batch], [batch.slice(k, 20) for k in range(0, len(ids), 20)]):
        dealt = [r for out in S._deal(8)(iter(pieces)) for r in out.to_pylist()]
        dealt = pa.RecordBatch.from_pylist(sorted(dealt, key=lambda r: r["bucket"]))
        met = [r for out in S._meet(iter([dealt])) for r in out.to_pylist()]
        grams = [r["gram"] for r in met if r["kind"] == 1]
        assert max((grams.count(g) for g in set(grams)), default=0) <= S.GROUP
        assert len({(r["id"], r["start"]) for r in met if r["kind"] == 2}) > S.GROUP


@pytest.mark.parametrize("partitions", [1, 7, 90])
def test_suffix_dedup_of_a_line_in_most_documents(spark, partitions):
    """Crowded in a block of text, in some blocks only, and in none but altogether."""
    rows = crowded_rows()
    got = S.suffix_dedup(docs_df(spark, rows).repartition(partitions)).collect()
    assert multiset((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == multiset(substring_dedup(rows))


def line_places(rows):
    """Documents by place, in order of (id, digest): lines of each, and the place of each row."""
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, int(hashlib.sha256((r[1] or "").encode()).hexdigest()[:15], 16)))
    return order, [(t or "").split("\n") for _, t in order]


def coarse_chunks(lines):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    h = [signed(xxhash.xxh64_intdigest(x.encode(), seed=42)) % (1 << 31) for x in lines]
    start, out = 0, []
    for i in range(len(lines)):
        rolled = h[i] + 31 * (h[i - 1] if i else 0)
        if i == len(lines) - 1 or signed(xxhash.xxh64_intdigest(rolled.to_bytes(8, "little", signed=True), seed=42)) % SPACING == 0:
            out += [(start, i + 1)] * (i > start)
            start = i + 1
    return out


def parsed_lines(rows, removed=None):
    """(id, lines, removed, runs, kept text) of each row, by the rules of the operator on lists of lines."""
    order, docs = line_places(rows)
    first, found = {}, []
    for d, lines in enumerate(docs):
        spans = set(coarse_chunks(lines)) | {(k, k + 2) for k in range(len(lines) - 1)}
        for s, e in sorted(spans):
            f, at = first.setdefault(tuple(lines[s:e]), (d, s))
            if (f, at) != (d, s):
                found.append((d, s, e, f, at - s))
    reach = [{} for _ in docs]  # line: furthest (end, source, shift)

    def offer(d, s, e, f, shift):
        if e - s > 1:
            reach[d][s] = max(reach[d].get(s, (0,)), (e, f, shift))

    for d, f, shift in {(d, f, x) for d, _, _, f, x in found}:
        mine, theirs = docs[d], docs[f]
        if d != f:
            same = [0 <= i + shift < len(theirs) and mine[i] == theirs[i + shift] for i in range(len(mine))] + [False]
            s = 0
            for i, ok in enumerate(same):
                if not ok:
                    offer(d, s, i, f, shift)
                    s = i + 1
            continue
        own = [(s, e) for dd, s, e, ff, x in found if (dd, ff, x) == (d, f, shift)]
        pairs = sorted(s for s, e in own if e == s + 2)
        for s in pairs:
            if s - 1 not in pairs:
                e = s
                while e + 1 in pairs:
                    e += 1
                offer(d, s, min(e + 2, s - shift), f, shift)
        for s, e in own:
            if e > s + 2:
                offer(d, s, min(e, s - shift), f, shift)
    gone, held = [set() for _ in docs], [set() for _ in docs]
    for d, lines in enumerate(docs):
        p = 0
        while p < len(lines):
            best = max((r for s, r in reach[d].items() if s <= p), default=(0,))
            if best[0] > p + 1:
                gone[d] |= set(range(p, best[0]))
                held[best[1]] |= set(range(p + best[2], best[0] + best[2]))
                p = best[0]
            else:
                p += 1
    out = {}
    for d, (i, t) in enumerate(order):
        left = gone[d] - held[d]
        left = {k for k in left if k - 1 in left or k + 1 in left}
        kept = None if t is None else "\n".join(x for k, x in enumerate(docs[d]) if k not in left)
        if removed is not None:
            removed[i, t] = left
        out[i, t] = (i, len(docs[d]), len(left), sum(k - 1 not in left for k in left), kept)
    return [out[r] for r in rows]


def repeated_lines(rows):
    """Lines in runs of two lines or more that also occur earlier."""
    _, docs = line_places(rows)
    seen, n = set(), 0
    for lines in docs:
        gone = set()
        for k, pair in enumerate(zip(lines, lines[1:])):
            gone |= {k, k + 1} if pair in seen else set()
            seen.add(pair)
        n += len(gone)
    return n


def passages():
    """Short passages amid other lines, chains of overlapping ones, lines repeated in place."""
    rng = np.random.default_rng(8)
    found = [[f"p{p} {k}" for k in range(2 + p % 5)] for p in range(40)]
    rows = hostile_rows() + [(250, "\n\n\na\n"), (251, "a\n\n\n"), (252, "\na")]
    for k in range(80):
        rows.append((300 + k, "\n".join([f"own {k} a", *found[k % 40], f"own {k} b", *found[rng.integers(40)][1:], f"own {k} c"])))
    rows += [(400, "A\nB"), (401, "B\nC"), (402, "A\nB\nC"), (403, "A\nB\nC"), (410, "h\nX\nX\nX\nX\nt"), (411, "\n".join("ABCDEABCDEABCDEAB"))]
    rows += [(420 + k, "\n".join(f"l{x}" for x in rng.integers(0, 6, 12))) for k in range(20)]
    return rows


def test_line_dedup(spark):
    rows = passages()
    got = line_dedup(docs_df(spark, rows)).collect()
    assert multiset((r.doc_id, r.n_lines, r.n_removed_lines, r.n_removed_chunks, r.kept_text) for r in got) == multiset(parsed_lines(rows))
    assert sum(r.n_removed_lines for r in got) > 300


def test_line_dedup_removes_only_what_repeats_whole(spark):
    chain = [(0, "A\nB"), (1, "B\nC"), (2, "A\nB\nC"), (3, "h\nX\nX\nX\nX\nt"), (4, "u\nA\nB\nC\nv")]
    got = {r.doc_id: r.kept_text for r in line_dedup(docs_df(spark, chain)).collect()}
    assert got[2] in ("C", "A", "A\nB\nC") and got[3] == "h\nX\nX\nt" and got[0] == "A\nB" and got[1] == "B\nC"
    rows, removed = passages(), {}
    kept = [(k[4] or "").split("\n") for k in parsed_lines(rows, removed)]  # as the operator has it: test_line_dedup
    whole = {pair for lines in kept for pair in zip(lines, lines[1:])}
    for (_, t), gone in removed.items():
        lines = (t or "").split("\n")
        for k in gone:  # what goes is part of a run that stays whole elsewhere
            assert any(0 <= s and s + 1 < len(lines) and (lines[s], lines[s + 1]) in whole for s in (k - 1, k))


def test_line_dedup_recall(spark):
    """Of all lines in repeated runs, whatever their place in the documents."""
    import duckdb

    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    n = sum(r.n_removed_lines for r in line_dedup(docs_df(spark, rows)).collect())
    assert 0.9 * repeated_lines(rows) <= n <= repeated_lines(rows)


@pytest.mark.parametrize("operator", [exact_dedup, near_dedup, line_dedup, S.suffix_dedup, drop_copies, drop_near_copies])
def test_empty_table(spark, operator):
    assert operator(docs_df(spark, [])).count() == 0
    assert operator(docs_df(spark, [(None, None)])).count() == 1
