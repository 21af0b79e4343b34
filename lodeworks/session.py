"""A session with the settings the engine is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(name: str = "lodeworks", **settings: str) -> SparkSession:
    """Adaptive plans, UTC and Arrow; any other setting by keyword, dots as double underscores."""
    builder = SparkSession.builder.appName(name)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (base | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
