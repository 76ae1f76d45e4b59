"""Identity resolution against a plain-Python brute force of the same rules on random rows."""

import random
import re

from helpers import upload_df, users_df
from punchspark.operators.identity import match_names, punch_cells, resolve_identity

DUMMY = {"", "16777985", "0", "NULL"}
WORDS = ["ann", "lee", "mary", "john", "smith", "raj", "kumar", "li", "o'neil", "de", "la", "cruz", "x"]


def normalize(s: str) -> str:
    s = s.strip()
    s = re.sub(r"(?i)^null\s+", "", s)
    s = re.sub(r"(?i)\s+null$", "", s)
    s = re.sub(r"\(.*?\)", "", s)
    s = re.sub(r"\d+", "", s)
    s = re.sub(r"[.,/#!$%^&*;:{}=\-_`~?]", " ", s)
    s = re.sub(r"\s+", " ", s).strip()
    return " ".join(w for w in s.split(" ") if len(w) > 1)


def squash(s: str) -> str:
    return re.sub(r"\s+", "", s.strip().lower())


def brute(users, rows):
    keys = {u[1].strip().upper() for u in users}
    index = {}
    for uid, emp, first, last in sorted(users):
        f, l = squash(first or ""), squash(last or "")  # noqa: E741
        if f and l:
            index[f + l] = emp
            index[l + f] = emp
        elif f:
            index[f] = emp
        elif l:
            index[l] = emp
    out = []
    for pid, first, last in rows:
        raw = pid.strip().upper()
        if raw not in DUMMY and raw in keys:
            out.append((raw, "id"))
            continue
        name = f"{first} {last}".strip()
        hit, how = None, None
        if name:
            norm = normalize(name)
            hit = index.get(squash(norm)) if norm else None
            how = "exact" if hit else None
            ws = [w for w in norm.split(" ") if w]
            if not hit and len(ws) >= 2:
                a, b, z = ws[0].lower(), ws[1].lower(), ws[-1].lower()
                hit = index.get(a + b) or index.get(b + a) or index.get(a + z) or index.get(z + a)
                how = "words" if hit else None
            if not hit and first != "":
                needle = first.lower().strip()
                if len(needle) > 2:
                    for k, v in index.items():
                        if needle in k:
                            hit, how = v, "loose"
                            break
        if hit and hit in keys:
            out.append((hit, how))
        else:
            out.append((raw or "NOT PROVIDED", "none"))
    return out


def noisy(rnd, words):
    w = list(words)
    if rnd.random() < 0.3:
        rnd.shuffle(w)
    s = " ".join(x.upper() if rnd.random() < 0.3 else x for x in w)
    if rnd.random() < 0.2:
        s += f" {rnd.randint(1, 99)}"
    if rnd.random() < 0.1:
        s = "NULL " + s
    if rnd.random() < 0.1:
        s += " (contract)"
    return s


def test_identity_matches_brute_force(spark):
    rnd = random.Random(11)
    users = []
    for i in range(40):
        first = " ".join(rnd.sample(WORDS, rnd.choice([0, 1, 1, 2])))
        last = " ".join(rnd.sample(WORDS, rnd.choice([0, 1, 1])))
        users.append((i + 1, f"E{i:03d}", first, last))
    rows = []
    for _ in range(400):
        u = rnd.choice(users)
        pid = rnd.choice(["", "0", "NULL", "16777985", f" {u[1].lower()} ", "ZZ1", u[1]])
        first = noisy(rnd, u[2].split()) if u[2] and rnd.random() < 0.8 else rnd.choice(["", "Ann", "Rajesh", "x"])
        last = noisy(rnd, u[3].split()) if u[3] and rnd.random() < 0.8 else rnd.choice(["", "Lee", "Q"])
        rows.append((pid, first, last))
    udf = users_df(spark, [(uid, emp, f, l, 1, "User", None, True) for uid, emp, f, l in users])
    up = upload_df(spark, ["PersonNo", "PersonFirstName", "PersonLastName"], [list(r) for r in rows])
    got = resolve_identity(punch_cells(up), udf).orderBy("row_ord").collect()
    expected = brute(users, rows)
    assert [(r["EmployeeNo"], r["match_method"]) for r in got] == expected


JS_WS_PY = "[\\s\ufeff]"  # JavaScript \s also covers the BOM


def normalize_js(s: str) -> str:
    s = re.sub(rf"^{JS_WS_PY}+|{JS_WS_PY}+$", "", s)
    s = re.sub(rf"(?i)^null{JS_WS_PY}+", "", s)
    s = re.sub(rf"(?i){JS_WS_PY}+null$", "", s)
    s = re.sub(r"\(.*?\)", "", s)
    s = re.sub(r"\d+", "", s)
    s = re.sub(r"[.,/#!$%^&*;:{}=\-_`~?]", " ", s)
    s = re.sub(rf"{JS_WS_PY}+", " ", s)
    s = re.sub(rf"^{JS_WS_PY}+|{JS_WS_PY}+$", "", s)
    return " ".join(w for w in s.split(" ") if len(w) > 1)


def test_normalize_name_matches_brute_force(spark):
    from punchspark.functions.text import normalize_name

    rnd = random.Random(3)
    alphabet = list("abcXYZ") + list("0123456789") + list(".,/#!$%^&*;:{}=-_`~?()'") + [" ", " ", "\t", "\u00a0", "\ufeff", "\u3000", "\u00e9"]
    texts = []
    for _ in range(400):
        s = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 18)))
        if rnd.random() < 0.2:
            s = rnd.choice(["NULL ", "null\u00a0", " Null  "]) + s
        if rnd.random() < 0.2:
            s = s + rnd.choice([" NULL", "\tnull", " nUlL "])
        texts.append(s)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["n"] for r in df.select("i", normalize_name("t").alias("n")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == normalize_js(t), repr(t)


def test_loose_match_of_many_names_with_one_beginning(spark):
    """Thousands of keys share their first letters: each name still meets one lookup row."""
    index = spark.range(3000).selectExpr("concat('mohammed', lpad(id, 4, '0')) AS key", "cast(id AS string) AS emp", "struct(id AS UserID, 0 AS slot) AS pos")
    names = spark.range(0, 3000, 3).selectExpr("concat('raw', id) AS raw_name", "concat('hammed', lpad(id, 4, '0')) AS first_cell", "'' AS norm")
    names = names.unionAll(spark.sql("SELECT 'short', 'mo', ''")).unionAll(spark.sql("SELECT 'first', 'Mohammed', ''"))
    got = {r["raw_name"]: (r["matched"], r["method"]) for r in match_names(names, index).collect()}
    want = {f"raw{i}": (str(i), "loose") for i in range(0, 3000, 3)} | {"short": (None, None), "first": ("0", "loose")}
    assert got == want
