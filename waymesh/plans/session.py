"""A session with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "waymesh", master: str | None = None, **more: str) -> SparkSession:
    """Adaptive execution (joins by size, skewed partitions split) and UTC; *more* by names with ``__`` for dots."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    } | {k.replace("__", "."): v for k, v in more.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


#: What a task gets of a shuffle, about, and into how many parts a shuffle is cut before those that are smaller are put together.
PART_BYTES, PARTS = "16m", 256


def bounded(spark: SparkSession) -> SparkSession:
    """Bounds the memory of a task: rows of keys and counts take many times their shuffled bytes in hash tables. What the session has set stays."""
    for name, value in (("advisoryPartitionSizeInBytes", PART_BYTES), ("coalescePartitions.initialPartitionNum", PARTS)):
        if spark.conf.get(f"spark.sql.adaptive.{name}", None) is None:
            spark.conf.set(f"spark.sql.adaptive.{name}", value)
    return spark
