"""Session helpers. Operators never create or look up a session of their own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, app: str = "caseloom", shuffle_partitions: int | None = None,
                  **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine.

    On a cluster the session comes from ``spark-submit``; there the shuffle
    partition count is left to AQE, starting from a high
    ``spark.sql.adaptive.coalescePartitions.initialPartitionNum``.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
