"""The session the engine runs in."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "colloquy", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, AQE with skew joins on; on a cluster the caller's own settings stand."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
