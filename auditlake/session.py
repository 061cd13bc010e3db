"""Session settings that every entry point shares."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "auditlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; cluster settings come from the environment."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
