"""The Spark session of the library."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "ledgerfold", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Zstandard Parquet; the master and partitions of the cluster unless given."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.parquet.compression.codec": "zstd",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    builder = SparkSession.builder.appName(name).config(map=settings | conf)
    return (builder.master(master) if master else builder).getOrCreate()
