"""A session with the settings the library is tested with."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "promptloom", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution, UTC and ANSI; the master and everything else come from the cluster unless given."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
