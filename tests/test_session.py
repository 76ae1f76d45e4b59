from punchspark.session import cluster_conf, ensure_checkpoint_dir


def test_cluster_conf_sizes_partitions():
    small = cluster_conf(10 * 1024**3)
    big = cluster_conf(100 * 1024**4)
    assert small["spark.sql.shuffle.partitions"] == "200"
    assert big["spark.sql.shuffle.partitions"] == str(100 * 1024**4 // (128 * 1024**2))
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"


def test_checkpoint_dir_is_read_from_the_session(spark):
    first = ensure_checkpoint_dir(spark)
    assert first and ensure_checkpoint_dir(spark) == first  # set once, then reused
