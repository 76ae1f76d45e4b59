"""Write a k-times replicated copy of the test tables (keys shifted per replica) for scaling runs.

Usage: python tools/replicate.py SRC_DIR DST_DIR K
Events, customers, parts and suppliers are copied K times with every key shifted by
replica * 10**7, so user-days, rosters and name indexes grow K-fold; nation is unchanged.
"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from punchspark.session import local_session  # noqa: E402

STRIDE = 10**7
KEYS = {"events": ["event_id", "user_id"], "customer": ["c_custkey"], "part": ["p_partkey"], "supplier": ["s_suppkey"]}


def main() -> None:
    src, dst, k = sys.argv[1], sys.argv[2], int(sys.argv[3])
    spark = local_session(8)
    for name, keys in KEYS.items():
        df = spark.read.parquet(f"{src}/{name}.parquet").withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        for c in keys:
            df = df.withColumn(c, (F.col(c) + F.col("replica") * STRIDE).cast(df.schema[c].dataType))
        df.drop("replica").repartition(16).write.mode("overwrite").parquet(f"{dst}/{name}.parquet")
    spark.read.parquet(f"{src}/nation.parquet").write.mode("overwrite").parquet(f"{dst}/nation.parquet")
    spark.stop()


if __name__ == "__main__":
    main()
