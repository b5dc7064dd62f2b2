"""Session settings that the jobs are tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Joins on a hot key (one bot wrote a third of the messages) are split at run time.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # Lists are collected for many small groups; the default gives up hashing at 128 of them.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "8192",
    # Needed by the keyed stream operators.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app_name: str = "palimpsest", **settings: str) -> SparkSession:
    """A session with SETTINGS; keyword names use ``__`` for the dots of a setting."""
    builder = SparkSession.builder.appName(app_name)
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    for name, value in settings.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()
