"""Hostile rows and brute-force versions for the training-data operators."""

import hashlib
import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, row int, bucket string, `a.b` string"
LOWER_AZ = {c: c + 32 for c in range(65, 91)}


def docs_df(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, None, None, None if t is None else len(t), True, 1, "x", "y") for i, t in rows], DOCS)


def hostile_rows(seed=11):
    """Nulls, empty and very long texts, ties, repeated rows, edited and exact copies, shared passages."""
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Über", "straße", "naïve", "x1", "日本", "Ω", "don't", "we'll"] + ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    shared = prose(80)
    base = prose(200)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "ONE  two\n"), (5, "a" * 300), (6, "a" * 500), (7, "\x00b\x00" * 60)]
    rows += [(10 + k, prose(rng.randint(3, 120))) for k in range(25)]
    rows += [(40 + k, prose(30) + "\n" + shared + "\n" + prose(30)) for k in range(5)]
    for k in range(12):
        words = base.split(" ")
        for _ in range(k // 3):
            words[rng.randrange(len(words))] = "edit" + str(rng.randrange(10**6))
        rows.append((60 + k, " ".join(words)))
    rows += [(80, base), (81, base.upper()), (82, base.replace(" ", "  ")), (83, "\n".join(["same line"] * 20)), (84, "\n".join(["same line"] * 20))]
    passage = "\n".join(prose(4) for _ in range(25))
    rows += [(85 + k, f"{prose(3)}\n{passage}\n{prose(3)}") for k in range(3)]
    rows += [(90, prose(6000)), (91, "z" * 40_000 + " " + prose(2000))]
    rows += [rows[12], rows[12], (None, prose(50)), (None, base)]
    rng.shuffle(rows)
    return rows


def near_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER_AZ))


def near_set(text):
    w = near_words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_components(rows, percent=85):
    """(set size, smallest id reachable) of each row."""
    sets = [near_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return [(len(sets[k]), least.get(root(k)) if sets[k] else rows[k][0]) for k in range(len(rows))]


def substring_dedup(rows, length=100):
    """(id, bytes, removed, runs, digest) of each row, in order of (id, digest)."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    seen, out = set(), []
    for i, t in order:
        raw = (t or "").encode()
        covered = [False] * len(raw)
        for s in range(len(raw) - length + 1):
            if raw[s : s + length] in seen:
                covered[s : s + length] = [True] * length
            else:
                seen.add(raw[s : s + length])
        runs = sum(c and (k == 0 or not covered[k - 1]) for k, c in enumerate(covered))
        kept = bytes(x for x, c in zip(raw, covered) if not c)
        out.append((i, len(raw), sum(covered), runs, hashlib.sha256(kept).hexdigest()))
    return out


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER_AZ))


def contamination(rows, items, n=13):
    """(id, words, hit words, items) of each row."""
    windows = {}
    for item, t in items:
        w = bench_words(t)
        size = min(n, len(w))
        for s in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[s : s + size]), set()).add(str(item))
    out = []
    for i, t in rows:
        w, hit, found = bench_words(t), set(), set()
        for size in {len(x) for x in windows}:
            for s in range(len(w) - size + 1):
                if (got := windows.get(tuple(w[s : s + size]))) is not None:
                    hit.update(range(s, s + size))
                    found |= got
        out.append((i, len(w), len(hit), sorted(found)))
    return out


def multiset(rows):
    return sorted(rows, key=repr)
