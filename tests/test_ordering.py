"""Running aggregates: groups cut by partition borders, null keys, ties."""

import random

import pytest
from pyspark.sql import functions as F

from punchspark.operators.ordering import running, running_count, running_sum, running_xor


@pytest.mark.parametrize("partitions", [1, 9])
def test_running_over_cut_groups(spark, partitions):
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 1, 1, 1, 2, k % 17 + 3]), rng.randint(0, 40), k, rng.getrandbits(50)) for k in range(900)]
    df = spark.createDataFrame(rows, "key long, t int, own long, x long")
    got = running(df, ["key"], [F.col("t"), F.col("own")], partitions, n=running_count(), s=running_sum("own"), x2=running_xor("x")).collect()
    state, want = {}, {}
    for key, t, own, x in sorted(rows, key=lambda r: (r[1], r[2])):
        n, s, y = state.get(key, (0, 0, 0))
        state[key] = want[own] = (n + 1, s + own, y ^ x)
    assert {r.own: (r.n, r.s, r.x2) for r in got} == want and len(got) == len(rows)


def test_running_on_ties_and_empty(spark):
    df = spark.createDataFrame([(1, 5)] * 50, "key int, t int")
    assert sorted(r.n for r in running(df, ["key"], [F.col("t")], 6, n=running_count()).collect()) == list(range(1, 51))
    assert running(df.where("key = 9"), ["key"], [F.col("t")], n=running_count()).count() == 0
