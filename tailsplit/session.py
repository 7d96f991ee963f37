"""Session defaults used by the tests, the benchmark and the examples."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(master: str = "local[*]", app: str = "tailsplit", shuffle_partitions: int = 8,
                driver_memory: str = "8g", **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow batches.

    On a cluster the session comes from the platform; nothing in the package needs more
    than ``spark.checkpoint.dir`` to be set there.
    """
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
