"""The driver contract: entry() runs, every query of the engine has an oracle, and all match at sf0.001."""

import os
import sys

import duckdb

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from oracle_check import SPARK_TO_DUCK, TABLES, digest  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_entry_and_all_oracles(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    assert entry(spark).count() > 0
    from punchspark.plans.queries import REGISTRY

    qs, sqls = {k: v for k, v in queries().items() if k in REGISTRY}, oracle_sql()
    assert set(qs) == set(REGISTRY) <= set(sqls) <= set(queries())
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    failures = []
    for name, fn in qs.items():
        df = fn(spark, SF)
        cols = sorted(df.columns)
        srows = [tuple(r[c] for c in cols) for r in df.collect()]
        rel = con.sql(sqls[name])
        ocols = list(rel.columns)
        types = dict(zip(ocols, [str(t) for t in rel.types]))
        orows = [tuple(r[ocols.index(c)] for c in cols) for r in rel.fetchall()] if sorted(ocols) == cols else None
        if orows is None:
            failures.append((name, "columns"))
        elif any(SPARK_TO_DUCK.get(t, t) != types[c] for c, t in df.dtypes):
            failures.append((name, "types"))
        elif len(srows) != len(orows) or digest(srows) != digest(orows):
            failures.append((name, "values"))
    assert failures == []
