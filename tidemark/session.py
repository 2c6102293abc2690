"""Session settings the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

# UTC everywhere: naive times in the data are UTC.  AQE sizes shuffles, turns small sides
# into broadcasts by measured size, and splits skewed join partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.caseSensitive": "true",
}


def session(name: str = "tidemark", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for k, v in {**SETTINGS, **extra}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
