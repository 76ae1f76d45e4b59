"""The pipeline against a brute-force version of its stages, and the registry."""

import os
import re
import sys

from data import contamination, hostile_rows, near_components

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)


def test_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline as P

    rows = list(dict.fromkeys((i, t) for i, t in hostile_rows() if i is not None))
    items = [(1, dict(rows)[41][200:700])]
    data = [(i, t, "en", "src", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    groups = {}
    for i, t in rows:  # labels of one kind: the classifier keeps all
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i, t))
    left = [(g[1], g[2]) for g in map(min, groups.values())]
    left = [r for r, (n, least) in zip(left, near_components(left, 80)) if least == r[0]]
    left = [r for r, (_, n, hit, _) in zip(left, contamination(left, items)) if not (hit and 20 * hit >= n)]
    assert {r.doc_id for r in P.run(spark, str(tmp_path)).collect()} == {i for i, _ in left}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_registry():
    import __spark_entry__ as e

    names = [q for q in e.queries() if q.startswith("op")]
    assert [int(q[2:].split("_")[0]) for q in names] == list(range(1, 14)) and "pipeline" in e.queries()


def test_oracles(spark):
    import duckdb

    import __spark_entry__ as e
    from punchspark.llm.queries import ORACLES

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in ORACLES.items():
        df = e.queries()[name](spark, sf)
        want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall()
        assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr), name
