"""Running aggregates over ordered groups of any size.

A window over ``keys`` sends every group to one task. Here rows are range-partitioned by
(keys, order), so a group that is larger than a partition is cut, and every partition
is aggregated by itself; what a cut group has gathered before a partition is carried into it.
Only the first group of a partition can have begun earlier, so the carried table has at
most one group per partition and is broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punchspark.operators.common import checkpointed

ROW, AT, PART = "__row", "__at", "__part"


def range_sorted(df: DataFrame, order: list[Column], partitions: int | None = None) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``, checkpointed, with ``__at`` (rising along the
    order) and ``__part``. Rows that tie follow their place in the input, and may be parted."""
    keys = [*order, F.col(ROW)]
    rows = df.withColumn(ROW, F.monotonically_increasing_id())
    ranged = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    staged = checkpointed(ranged.sortWithinPartitions(*keys).drop(ROW).withColumn(AT, F.monotonically_increasing_id()))
    return staged.withColumn(PART, F.shiftright(AT, 33))


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[f"`{c}`"].eqNullSafe(b[f"`{c}`"]) for c in names])


def running(df: DataFrame, keys: list[str], order: list[Column], partitions: int | None = None, **aggregates: tuple) -> DataFrame:
    """``df`` with one column for each of ``aggregates`` (name=(function, combine, column)): the function over the
    rows of the same keys up to this one in ``order``. ``combine`` joins two results, a null one being none.

    Null keys are a group like any other. Ties in ``order`` follow the input.
    """
    staged = range_sorted(df, [F.col(f"`{k}`").asc_nulls_first() for k in keys] + order, partitions)
    local = Window.partitionBy(PART, *[f"`{k}`" for k in keys]).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0)
    rows = staged.select("*", *[f(column).over(local).alias(f"__own_{name}") for name, (f, _, column) in aggregates.items()])

    # groups that open a partition: one per partition at most
    openers = staged.groupBy(PART).agg(F.min_by(F.struct(*[F.col(f"`{k}`") for k in keys]), AT).alias("key")).select(F.col("key.*")).distinct()
    cut = staged.join(F.broadcast(openers), _same(staged, openers, keys), "left_semi")
    totals = cut.groupBy(PART, *[f"`{k}`" for k in keys]).agg(*[f(column).alias(f"__sum_{name}") for name, (f, _, column) in aggregates.items()])
    before = Window.partitionBy(*[f"`{k}`" for k in keys]).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        F.col(PART).alias("__p"),
        *[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)],
        *[_again(f)(F.col(f"__sum_{name}")).over(before).alias(f"__in_{name}") for name, (f, _, _) in aggregates.items()],
    )
    on = [F.col(PART) == F.col("__p"), *[F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]]
    joined = rows.join(F.broadcast(carried), reduce(lambda x, y: x & y, on), "left")
    made = []
    for name, (_, combine, _) in aggregates.items():
        own, carry = F.col(f"__own_{name}"), F.col(f"__in_{name}")
        made.append(F.when(carry.isNull(), own).when(own.isNull(), carry).otherwise(combine(carry, own)).alias(name))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *made)


def _again(f):
    """The function that gathers results of ``f``: counts are summed, all others gather themselves."""
    return F.sum if f is F.count else f


def running_count() -> tuple:
    return F.count, lambda a, b: a + b, F.lit(1)


def running_sum(column: str) -> tuple:
    return F.sum, lambda a, b: a + b, F.col(f"`{column}`")


def running_xor(column: str) -> tuple:
    return F.bit_xor, lambda a, b: a.bitwiseXOR(b), F.col(f"`{column}`")
