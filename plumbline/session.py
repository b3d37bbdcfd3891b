"""A session with the settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "plumbline", master: str | None = None, **conf: str) -> SparkSession:
    """ANSI on, UTC, adaptive execution on.  Cluster sizes are left to the submitter."""
    settings = {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
