"""Session settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # By sizes as measured when the sides are ready: a map of 700,000 stops still goes to the schedules, not they to it.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32m",
    # Arrays are collected in sort order: the stops of a train are sorted by it already, and the hash aggregate of
    # arrays sorts its rows again from 128 groups on.
    "spark.sql.execution.useObjectHashAggregateExec": "false",
    # A job is many queries; the shuffle files of each go when it ends, not when the driver happens to collect garbage.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # Only the RocksDB provider supports the activation state of the movement stream.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def apply_settings(spark: SparkSession) -> SparkSession:
    """Set the runtime options on a session made elsewhere."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int = 8, memory: str = "8g", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("railbeam")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
