"""Physical-plan checks on Parquet inputs: pushdown, pruning, shuffle count, partial aggregation, skew."""

import os

from pyspark.sql import functions as F

from punchspark.operators import report_a as A
from punchspark.operators import report_b as B
from punchspark.plans import queries as Q
from punchspark.plans.driver_tables import engine_tables

SF = "/root/testdata/sf0.001"


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_report_a_pushdown_pruning_and_single_shuffle(spark):
    df = Q.daily_attendance_filtered(spark, SF)
    txt = plan_text(df)
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts,2024-01-05T00:00), LessThan(ts,2024-01-21T00:00)]" in txt
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in txt  # 2 of 6 event columns
    assert txt.count("Exchange hashpartitioning") == 1  # only the per-day aggregate shuffles
    assert "partial_min" in txt and "LeftSemi" in txt  # map-side combine; user filter as semi-join


def test_report_b_hash_aggregate_with_partial(spark):
    txt = plan_text(Q.export_daily(spark, SF))
    assert "SortAggregate" not in txt
    assert "partial_min_by" in txt
    # punches once (by raw ID, day and minute, combined before), their days once, the roster's IDs once
    shuffles = [x for x in txt.splitlines() if "Exchange hashpartitioning" in x]
    assert len(shuffles) == 3


def test_hot_key_is_combined_map_side(spark, tmp_path):
    """A third of all punches on one key ('UNKNOWN'): the aggregate still partially combines,
    and the result has exactly one row per day for it."""
    punches, users, depts = engine_tables(spark, SF)
    hot = punches.withColumn("EmployeeNo", F.when(F.col("LogID") % 3 == 0, F.lit(None)).otherwise(F.col("EmployeeNo")))
    path = str(tmp_path / "p")
    hot.write.parquet(path)
    hot = spark.read.parquet(path)
    rec = B.daily_report_b(hot, users, depts)
    unknown = rec.where(F.col("EmployeeID") == "UNKNOWN")
    days = hot.where(F.col("EmployeeNo").isNull()).select(F.to_date("PunchDateTime")).distinct().count()
    assert unknown.count() == days
    assert unknown.agg(F.sum("punch_count")).first()[0] == hot.where(F.col("EmployeeNo").isNull()).count()
    assert "partial_" in plan_text(rec)


def test_dimensions_broadcast_only_when_small(spark):
    punches, users, depts = engine_tables(spark, SF)
    txt = plan_text(A.daily_attendance(punches, users, depts))
    assert "BroadcastHashJoin" in txt
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        txt2 = plan_text(A.daily_attendance(punches, users, depts))
        assert "BroadcastHashJoin" not in txt2 and "SortMergeJoin" in txt2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_with_an_id_are_not_shuffled_by_name(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        txt = plan_text(Q.punch_ingest(spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    union = txt[txt.index("Union"):]
    first = union.splitlines()[1]
    branch = first.index(":-")
    others = [i for i, line in enumerate(union.splitlines()[2:], 2) if line[branch:branch + 2] in ("+-", ":-")]
    by_id = "\n".join(union.splitlines()[1:others[0]])
    assert "raw_id" in by_id and "raw_name" not in by_id
    assert "raw_name" in union


def test_department_filter_reaches_below_the_aggregate(spark):
    txt = plan_text(Q.export_filtered(spark, SF))
    assert "LeftSemi" in txt and txt.index("min_by") < txt.index("LeftSemi")
