"""Sessions with the settings that the engine counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.enabled": "false",
}


def session(master: str = "local[*]", partitions: int = 8, **more: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("paperloom").config("spark.sql.shuffle.partitions", partitions)
    for key, value in (SETTINGS | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
