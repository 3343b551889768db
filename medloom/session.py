"""A Spark session with the settings that the engine's plans are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "medloom", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive plans, skewed joins split. Other settings by keyword, dots as double underscores."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
